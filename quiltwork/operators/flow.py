"""Placement that depends on what was placed before: rows, free rectangles and cuts. One group is one page set and one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACED = "id string, page bigint, x bigint, y bigint, frame_w bigint, frame_h bigint, rotated boolean"
SIZED = f"{PLACED}, page_w bigint, page_h bigint"
KINDS = {"id": pa.string(), "page": pa.int64(), "x": pa.int64(), "y": pa.int64(), "frame_w": pa.int64(), "frame_h": pa.int64(), "rotated": pa.bool_()}
Item = tuple[str, int, int]  # id, padded width and height
Placed = tuple[str, int, int, int, int, int, bool]
#: Scores of free rectangles and orders of rows, as "best" tries them.
SCORES = ("short", "area", "long", "bottom", "contact")
ORDERS = tuple((name, down) for name in ("name", "width", "height", "area", "around") for down in (False, True))


@dataclass(frozen=True)
class FlowOptions:
    """order: name, width, height, area, around (circumference) or best; score: short, long, area, bottom, contact or best.

    A side in fixed isn't searched. constraint: any, pot, x4 or word (widths that are multiples of word).
    """

    width: int = 512
    height: int = 512
    padding: int = 1
    border: int = 0
    align: int = 0
    rotate: bool = True
    order: str = "name"
    descending: bool = False
    score: str = "short"
    fixed: tuple[bool, bool] = (False, False)
    square: bool = False
    constraint: str = "any"
    word: int = 4

    def up(self, v):
        return up_to(v, self.align)

    @property
    def inner(self) -> tuple[int, int]:
        """Where the interior ends."""
        return self.width - self.border, self.height - self.border

    def step(self, side: int) -> int:
        """Sides that are searched are multiples of this."""
        return 4 if self.constraint == "x4" else self.word if self.constraint == "word" and side == 0 else 1


def up_to(v, step: int):
    """The next multiple of a step; steps below 2 change nothing."""
    return -(-v // step) * step if step > 1 else v


def misfit(name: str) -> ValueError:
    return ValueError(f"{name} doesn't fit on a page")


def check(items: Iterable[Item], o: FlowOptions) -> None:
    """An error if borders leave no room or an item is larger than the page, naming up to eight of them."""
    if min(o.inner) <= o.border:
        raise ValueError(f"a border of {o.border} leaves no room on {o.width} x {o.height}")
    large = [name for name, w, h in items if w > o.inner[0] - o.border or h > o.inner[1] - o.border]
    if large:
        raise misfit(", ".join(large[:8]) + (f" and {len(large) - 8} more" if len(large) > 8 else ""))


def rows_of(items: Iterable[Item], o: FlowOptions, top: int | None = None, step: int = 0) -> list[Placed]:
    return list(flowing(items, o, top, step))


def flowing(items: Iterable[Item], o: FlowOptions, top: int | None = None, step: int = 0) -> Iterator[Placed]:
    """From left to right, from row to row, from page to page; the first row starts at top.

    An item goes where the row has come to, else to a new row under the lowest item, else to a new page. With a step, rows
    and items begin at its multiples. Items beyond the page raise an error that names them.
    """
    right, bottom = o.inner
    page, x, low = 0, o.border, o.border if top is None else top
    row = up_to(low, step)
    for name, w, h in items:
        for where in ("row", "next row", "next page", "nowhere"):
            if where == "next row":
                x, row = o.border, up_to(low, step)
            elif where == "next page":
                page, x, row = page + 1, o.border, up_to(o.border, step)
                low = row
            elif where == "nowhere":
                raise misfit(name)
            px, py = o.up(up_to(x, step)), o.up(row)
            if px + w <= right and py + h <= bottom:
                break
        yield name, page, px, py, w, h, False
        x, low = px + w, max(low, py + h)


def strips(free: Sequence[int], used: Sequence[int], columns: bool) -> np.ndarray:
    """What an item leaves of a free rectangle, tiled: full-height columns beside it and its own column's ends, or the same by rows."""
    x, y, w, h = (int(v) for v in free)
    ux, uy, uw, uh = (int(v) for v in used)
    if columns:
        found = [(x, y, ux - x, h), (ux, y, uw, uy - y), (ux, uy + uh, uw, y + h - uy - uh), (ux + uw, y, x + w - ux - uw, h)]
    else:
        found = [(x, y, w, uy - y), (x, uy, ux - x, uh), (ux + uw, uy, x + w - ux - uw, uh), (x, uy + uh, w, y + h - uy - uh)]
    return np.array([t for t in found if t[2] > 0 and t[3] > 0], np.int64).reshape(-1, 4)


#: Free rectangles from which on a page has them in arrays.
MANY = 100


class Page:
    """The free rectangles of a page, in the order in which equal scores are settled, and what is on it.

    Rectangles are tuples of x, y and where they end: most pages have some tens of them, for which lists are faster than
    arrays. Pages that come to hold very many, as large ones of small items do, go on in arrays.
    """

    def __init__(self, o: FlowOptions, guillotine: bool) -> None:
        self.o, self.guillotine = o, guillotine
        self.listed = [(o.border, o.border, *o.inner)]
        self.wide: WidePage | None = None
        #: For the score by contact: of each column which rows are taken, as bits, and of each row which columns.
        self.columns: dict[int, int] = {}
        self.rows: dict[int, int] = {}

    @property
    def rects(self) -> list[tuple[int, int, int, int]]:
        return self.wide.rects if self.wide else self.listed

    @property
    def free(self) -> np.ndarray:
        """The free rectangles' x, y, width and height, a row each."""
        return np.array([(x, y, x1 - x, y1 - y) for x, y, x1, y1 in self.rects], np.int64).reshape(-1, 4)

    def contact(self, x: int, y: int, w: int, h: int) -> int:
        """How much of an item's sides would touch the page's edges or other items. What is taken beside a free place ends at its side."""
        high, wide, none = ((1 << h) - 1) << y, ((1 << w) - 1) << x, 0
        columns, rows = self.columns.get, self.rows.get
        out = (columns(x - 1, none) & high).bit_count() + (columns(x + w, none) & high).bit_count() + (rows(y - 1, none) & wide).bit_count() + (rows(y + h, none) & wide).bit_count()
        return out + h * ((x == 0) + (x + w == self.o.width)) + w * ((y == 0) + (y + h == self.o.height))

    def rank(self, x: int, y: int, w: int, h: int, a: int, b: int) -> tuple[int, ...]:
        """A candidate's keys, the first weighing most; lower is better. a, b: what the item leaves of the width and height."""
        short, long = (a, b) if a < b else (b, a)
        kind = self.o.score
        if kind == "short":
            return short, long
        if kind == "long":
            return long, short
        if kind == "area":
            return a * b, short
        if kind == "bottom":
            return y + h, x + w, short
        return -self.contact(x, y, w, h), short

    def spot(self, w: int, h: int) -> tuple[int, tuple[int, int, int, int], bool] | None:
        """The best free rectangle for an item, the item's rectangle, and whether it is turned; the first of equal ones, as it is before turned."""
        if self.wide:
            return self.wide.spot(w, h)
        step, turns, rank = self.o.align, self.o.rotate and w != h, self.rank
        best = found = None
        for k, (x, y, x1, y1) in enumerate(self.listed):
            if step > 1:
                x, y = -(-x // step) * step, -(-y // step) * step
            a, b = x1 - x, y1 - y
            if a >= w and b >= h:
                key = rank(x, y, w, h, a - w, b - h)
                if best is None or key < best:
                    best, found = key, (k, (x, y, w, h), False)
            if turns and a >= h and b >= w:
                key = rank(x, y, h, w, a - h, b - w)
                if best is None or key < best:
                    best, found = key, (k, (x, y, h, w), True)
        return found

    def take(self, k: int, used: Sequence[int], need: list[int] | None = None) -> None:
        """Puts an item into the free rectangle k. need: see needs(); free rectangles that are of no use any more may go."""
        x, y, w, h = (int(v) for v in used)
        if self.wide:
            self.wide.take(x, y, w, h, need)
            return
        self.listed = self.cut(k, (x, y, w, h)) if self.guillotine else self.carved(x, y, x + w, y + h)
        if self.o.score == "contact":
            high, wide = ((1 << h) - 1) << y, ((1 << w) - 1) << x
            for c in range(x, x + w):
                self.columns[c] = self.columns.get(c, 0) | high
            for r in range(y, y + h):
                self.rows[r] = self.rows.get(r, 0) | wide
        if len(self.listed) > MANY and not self.guillotine and max(self.o.width, self.o.height) < 1 << 20:
            self.wide = WidePage(self)
            self.listed, self.columns, self.rows = [], {}, {}

    def cut(self, k: int, used: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
        """The rest of one free rectangle is tiled so that the largest tile is as large as can be (by columns if both are); tiles go last, from left to right. Items off the corner are cut by columns."""
        x, y, x1, y1 = self.listed[k]
        by = [strips((x, y, x1 - x, y1 - y), used, columns).tolist() for columns in ((True, False) if (x, y) == used[:2] else (True,))]
        tiles = max(by, key=lambda t: max((w * h for _, _, w, h in t), default=0))
        return [*self.listed[:k], *self.listed[k + 1 :], *((x, y, x + w, y + h) for x, y, w, h in sorted(tiles, key=lambda t: t[:2]))]

    def carved(self, ux: int, uy: int, ux1: int, uy1: int) -> list[tuple[int, int, int, int]]:
        """Every free rectangle that meets the item gives way to the maximal ones beside it: left, right, above, below. None within another stays.

        A piece stands where its parent stood. What wasn't met was maximal before, so only pieces can lie within others; and
        what holds a piece beside one side of the item ends at that side too, so only such are compared.
        """
        out: list[tuple[int, int, int, int]] = []
        beside: tuple[list[int], ...] = ([], [], [], [])
        pieces: list[tuple[int, int]] = []
        for rect in self.listed:
            x, y, x1, y1 = rect
            if x < ux1 and ux < x1 and y < uy1 and uy < y1:
                for side, piece in enumerate(((x, y, ux, y1) if x < ux else None, (ux1, y, x1, y1) if ux1 < x1 else None, (x, y, x1, uy) if y < uy else None, (x, uy1, x1, y1) if uy1 < y1 else None)):
                    if piece:
                        pieces.append((side, len(out)))
                        out.append(piece)
                        x_, y_, x1_, y1_ = piece
                        for s, meets in enumerate((x1_ == ux, x_ == ux1, y1_ == uy, y_ == uy1)):
                            if meets:
                                beside[s].append(len(out) - 1)
            else:
                if x1 == ux:
                    beside[0].append(len(out))
                elif x == ux1:
                    beside[1].append(len(out))
                if y1 == uy:
                    beside[2].append(len(out))
                elif y == uy1:
                    beside[3].append(len(out))
                out.append(rect)
        gone = set()
        for side, k in pieces:
            x, y, x1, y1 = piece = out[k]
            for j in beside[side]:
                p, q, p1, q1 = out[j]
                # Of equal ones the first stays.
                if p <= x and q <= y and p1 >= x1 and q1 >= y1 and j != k and (j < k or out[j] != piece):
                    gone.add(k)
                    break
        return [r for k, r in enumerate(out) if k not in gone] if gone else out


class WidePage:
    """Page.spot() and Page.take() of a page without guillotine cuts, over arrays: the same places in the same order."""

    def __init__(self, page: Page) -> None:
        self.o = o = page.o
        self.kind = np.int16 if max(o.width, o.height) < 1 << 14 else np.int32
        self.table = self.columns(page.listed)
        if o.score == "contact":
            # Of each column which rows are taken, as bits, and of each row which columns; an empty line before and after both, an empty word after each.
            self.words = (max(o.width, o.height) >> 6) + 2
            self.taken = np.zeros((o.width + o.height + 4, self.words), np.uint64)
            for first, lines in ((1, page.columns), (o.width + 3, page.rows)):
                for k, bits in lines.items():
                    self.taken[first + k] = np.frombuffer(bits.to_bytes(8 * self.words, "little"), "<u8")

    def columns(self, rects: Sequence[tuple[int, int, int, int]]) -> np.ndarray:
        """A column for each rectangle: x, y and its ends, negative; the room from the place that alignment leaves an item on, and that place if it is another."""
        if self.o.align > 1:
            up = self.o.up
            return np.array([(x, y, -x1, -y1, x1 - up(x), y1 - up(y), up(x), up(y)) for x, y, x1, y1 in rects], self.kind).T
        return np.array([(x, y, -x1, -y1, x1 - x, y1 - y) for x, y, x1, y1 in rects], self.kind).T

    @property
    def rects(self) -> list[tuple[int, int, int, int]]:
        return [(x, y, -x1, -y1) for x, y, x1, y1 in self.table[:4].T.tolist()]

    def touching(self, lines: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
        """How many bits from a start on, so many, are taken in lines."""
        out, flat, n = np.zeros(len(lines), np.int64), self.taken.ravel(), np.uint64
        for at in range(0, int(many.max()), 64):
            word, off = lines * self.words + (start + at >> 6), (start + at & 63).astype(n)
            bits = (flat[word] >> off) | ((flat[word + 1] << n(1)) << (n(63) - off))
            none = np.clip(64 - (many - at), 0, 64)
            out += np.bitwise_count((bits << (none >> 1).astype(n)) << (none - (none >> 1)).astype(n))
        return out

    def contact(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Page.contact() of many places."""
        width, height, n = self.o.width, self.o.height, len(x)
        lines = np.concatenate([x, x + w + 1, y + width + 2, y + h + width + 3])
        found = self.touching(lines, np.concatenate([y, y, x, x]), np.concatenate([h, h, w, w])).reshape(4, n).sum(axis=0)
        return found + h * ((x == 0).astype(np.int64) + (x + w == width)) + w * ((y == 0).astype(np.int64) + (y + h == height))

    def spot(self, w: int, h: int) -> tuple[int, tuple[int, int, int, int], bool] | None:
        table, kind, best, beside = self.table, self.o.score, None, []
        wide, high, at = table[4], table[5], -2 if self.o.align > 1 else 0
        for tw, th, turned in ((w, h, False), (h, w, True)) if self.o.rotate and w != h else ((w, h, False),):
            (fit,) = ((wide >= tw) & (high >= th)).nonzero()
            if not len(fit):
                continue
            a, b = wide.take(fit) - tw, high.take(fit) - th
            # A side is below 2 ** 20, so all that a score compares goes into one number.
            short = np.minimum(a, b).astype(np.int64)
            if kind == "short":
                key = (short << 20) + np.maximum(a, b)
            elif kind == "long":
                key = (np.maximum(a, b).astype(np.int64) << 20) + short
            elif kind == "area":
                key = (a.astype(np.int64) * b << 20) + short
            elif kind == "bottom":
                key = ((table[at + 1].take(fit).astype(np.int64) + th << 20) + (table[at].take(fit) + tw) << 20) + short
            else:
                beside.append((fit, short, np.full(len(fit), tw), np.full(len(fit), th), np.full(len(fit), turned)))
                continue
            k = key.argmin()
            found = key[k], fit[k], turned
            if best is None or found < best:
                best = found
        if beside:
            fit, short, ws, hs, turned = (np.concatenate(c) for c in zip(*beside, strict=True)) if len(beside) > 1 else beside[0]
            key = short - (self.contact(table[at].take(fit).astype(np.int64), table[at + 1].take(fit).astype(np.int64), ws, hs) << 20)
            (k,) = (key == key.min()).nonzero()
            best = min((0, fit[i], bool(turned[i])) for i in k.tolist())
        if best is None:
            return None
        k = int(best[1])
        return k, (int(table[at, k]), int(table[at + 1, k]), *((h, w) if best[2] else (w, h))), best[2]

    def take(self, ux: int, uy: int, w: int, h: int, need: list[int] | None) -> None:
        """Page.carved() and what is taken. Few rectangles meet an item."""
        ux1, uy1, table = ux + w, uy + h, self.table
        (near,) = ((table[0] <= ux1) & (table[1] <= uy1) & (table[2] <= -ux) & (table[3] <= -uy)).nonzero()
        met, beside, pieces = [], [], []
        for k, (x, y, x1, y1) in zip(near.tolist(), table[:4, near].T.tolist(), strict=True):
            x1, y1 = -x1, -y1
            if x < ux1 and ux < x1 and y < uy1 and uy < y1:
                met.append(k)
                for piece in ((x, y, ux, y1) if x < ux else None, (ux1, y, x1, y1) if ux1 < x1 else None, (x, y, x1, uy) if y < uy else None, (x, uy1, x1, y1) if uy1 < y1 else None):
                    if piece:
                        if need:
                            a, b = piece[2] - piece[0], piece[3] - piece[1]
                            if (b < need[a] if a < len(need) else b < need[-1]) if a < b else (a < need[b] if b < len(need) else a < need[-1]):
                                continue
                        pieces.append((k, piece))
            else:
                beside.append((x, y, x1, y1))
        stay = []
        for k, (parent, piece) in enumerate(pieces):
            x, y, x1, y1 = piece
            for p, q, p1, q1 in beside:
                if p <= x and q <= y and p1 >= x1 and q1 >= y1:
                    break
            else:
                for j, (_, other) in enumerate(pieces):
                    # Of equal ones the first stays.
                    if other[0] <= x and other[1] <= y and other[2] >= x1 and other[3] >= y1 and j != k and (j < k or other != piece):
                        break
                else:
                    stay.append((parent, piece))
        new, parts, last, begin = self.columns([p for _, p in stay]) if stay else table[:, :0], [], 0, 0
        for k in met:
            end = begin
            while end < len(stay) and stay[end][0] == k:
                end += 1
            parts += [table[:, last:k], new[:, begin:end]]
            last, begin = k + 1, end
        self.table = np.concatenate([*parts, table[:, last:]], axis=1)
        if self.o.score == "contact":
            for first, a, n, b, m in ((1, ux, w, uy, h), (self.o.width + 3, uy, h, ux, w)):
                bits = np.frombuffer((((1 << m) - 1) << (b & 63)).to_bytes(8 * ((b + m - 1 >> 6) - (b >> 6) + 1), "little"), "<u8")
                self.taken[first + a : first + a + n, b >> 6 : (b >> 6) + len(bits)] |= bits

    def useful(self, need: list[int]) -> None:
        """Leaves out free rectangles that no item to come fits."""
        short, long = np.minimum(self.table[4], self.table[5]), np.maximum(self.table[4], self.table[5])
        self.table = self.table[:, long >= np.minimum(need, 1 << 14 if self.kind == np.int16 else 1 << 30)[np.clip(short, 0, len(need) - 1)]]


def needs(short: np.ndarray, long: np.ndarray) -> list[int]:
    """By a free rectangle's lesser side (the last for all greater ones) what its greater side has to be, at least, for any item to fit, of items' lesser and greater sides."""
    out = np.full(int(short.max()) + 1, 1 << 62, np.int64)
    np.minimum.at(out, short, long)
    return np.minimum.accumulate(out).tolist()


class Shelf:
    """The pages of a set, and which of them may still hold items of a size.

    Room on a page only shrinks, so a page that has no place for a size never has one again: for each size pages are
    asked once more only as long as they hold it. A size that comes for the first time skips pages whose largest or
    thickest free rectangle is too small.
    """

    def __init__(self, o: FlowOptions, guillotine: bool) -> None:
        self.o, self.guillotine = o, guillotine
        self.pages: list[Page] = []
        self.bounds: list[tuple[int, int]] = []  # of each page an upper bound of its free rectangles' lesser sides and areas
        self.able: dict[tuple[int, int], tuple[list[int], int]] = {}  # of a size pages that may hold it, and how many pages were seen

    def spot(self, w: int, h: int) -> tuple[int, int, tuple[int, int, int, int], bool] | None:
        """The newest page with room, and Page.spot() of it."""
        size = (min(w, h), max(w, h)) if self.o.rotate else (w, h)
        thick, area = min(w, h), w * h
        if len(self.able) > 100_000:
            self.able.clear()
        left, seen = self.able.get(size, ([], 0))
        left += [n for n in range(seen, len(self.pages)) if self.bounds[n][0] >= thick and self.bounds[n][1] >= area]
        found = None
        while left and not (found := self.pages[left[-1]].spot(w, h)):
            n = left.pop()
            if n < len(self.pages) - 1:
                # An older page changes seldom, so its bounds are taken when it disappoints.
                self.bounds[n] = max((min(x1 - x, y1 - y) for x, y, x1, y1 in self.pages[n].rects), default=0), max(((x1 - x) * (y1 - y) for x, y, x1, y1 in self.pages[n].rects), default=0)
        self.able[size] = left, len(self.pages)
        return (left[-1], *found) if found else None

    def open(self) -> None:
        self.pages.append(Page(self.o, self.guillotine))
        self.bounds.append((1 << 62, 1 << 62))


def free_rectangles(items: Iterable[Item], o: FlowOptions, guillotine: bool, pages: int | None = None) -> list[Placed] | None:
    """Items by descending area, each on the newest page with room, at the best free rectangle, turned if that is better. With a number of pages, None if more are needed."""
    shelf, out, need = Shelf(o, guillotine), [], None
    items = sorted(items, key=lambda i: -i[1] * i[2])
    sides = np.sort(np.array([i[1:] for i in items], np.int64).reshape(-1, 2), axis=1)
    step = max(100, len(items) // 16)
    for k, (name, w, h) in enumerate(items):
        if k % step == 0 and k:
            # The items to come need ever less of what is free.
            need = needs(*sides[k:].T)
            for page in shelf.pages:
                if page.wide:
                    page.wide.useful(need)
        found = shelf.spot(w, h)
        if not found:
            if len(shelf.pages) == pages:
                return None
            shelf.open()
            if not (found := shelf.spot(w, h)):
                raise misfit(name)
        n, at, rect, turned = found
        shelf.pages[n].take(at, rect, need)
        out.append((name, n, *rect, turned))
    return out


def ordered(rows: list[tuple[int, str, int, int]], o: FlowOptions) -> list[Item]:
    """Padded items (ord, id, w, h given) in the wanted order; ties keep the order of ord, descending or not."""
    key = {"name": lambda r: r[1], "width": lambda r: r[2], "height": lambda r: r[3], "area": lambda r: r[2] * r[3], "around": lambda r: r[2] + r[3]}[o.order]
    rows = sorted(sorted(rows), key=key, reverse=o.descending)  # equal keys keep their order either way
    return [(i, w + 2 * o.padding, h + 2 * o.padding) for _, i, w, h in rows]


def extents(placed: Iterable[Placed]) -> dict[int, tuple[int, int]]:
    """Of each page where its content ends."""
    out: dict[int, tuple[int, int]] = {}
    for _, page, x, y, w, h, _ in placed:
        a, b = out.get(page, (0, 0))
        out[page] = max(a, x + w), max(b, y + h)
    return out


def tightest(tries: Iterator[list[Placed] | None]) -> list[Placed] | None:
    """The fewest pages, then the least sum of content areas; the first of equal ones. No more than two are held at a time."""
    size = lambda placed: ((e := extents(placed)) and len(e), sum(a * b for a, b in e.values()))
    best = least = None
    for t in tries:
        if t is not None and (least is None or size(t) < least):
            best, least = t, size(t)
        t = None
    return best


def placed_as(rows: list[tuple[int, str, int, int]], how: str, o: FlowOptions, pages: int | None = None) -> list[Placed] | None:
    """The placement of (ord, id, w, h); how: rows, maxrects or guillotine. With a number of pages, None if more are needed."""
    if how == "rows":
        if o.order == "best":
            # Orders are compared by the ends of their pages alone, then the best one is placed again: ten placements at once would be large.
            size = lambda t: ((e := extents(flowing(ordered(rows, t), t))) and len(e), sum(a * b for a, b in e.values()))
            o = min((replace(o, order=order, descending=down) for order, down in ORDERS), key=size)
        found = rows_of(ordered(rows, o), o)
        return None if pages is not None and found and max(p[1] for p in found) >= pages else found
    items = ordered(rows, replace(o, order="name", descending=False) if o.order == "best" else o)
    return tightest(free_rectangles(items, t, how == "guillotine", pages) for t in scored(o))


def scored(o: FlowOptions) -> list[FlowOptions]:
    return [replace(o, score=s) for s in SCORES] if o.score == "best" else [o]


def smallest(rows: list[tuple[int, str, int, int]], how: str, o: FlowOptions, passes: int) -> FlowOptions:
    """The smallest page found that holds all rows: each pass bisects the width, then the height, until a pass changes nothing.

    A side is tried only if the items' area and largest side allow it.
    """
    pad, best = 2 * o.padding, [o.width, o.height]
    least = [max(r[2 + k] for r in rows) + pad + 2 * o.border for k in (0, 1)]
    area = sum((r[2] + pad) * (r[3] + pad) for r in rows)
    known: dict[tuple[int, int], bool] = {}
    scores = [t.score for t in scored(o)] if how != "rows" else [o.score]

    def holds(size: list[int]) -> bool:
        key = (size[0], size[1])
        if key not in known:
            own = replace(o, width=size[0], height=size[1])
            known[key] = not (o.square and size[0] != size[1]) and (own.inner[0] - o.border) * (own.inner[1] - o.border) >= area and held(own)
        return known[key]

    def held(own: FlowOptions) -> bool:
        """Whether any score places all; the one that last did is asked first."""
        try:
            for s in scores:
                if placed_as(rows, how, replace(own, score=s), 1) is not None:
                    scores.insert(0, scores.pop(scores.index(s)))
                    return True
        except ValueError:
            pass
        return False

    def sides(k: int) -> list[int]:
        """Values that a side may take, ascending, the present one last."""
        if o.constraint == "pot":
            return [v for v in (1 << b for b in range(32)) if least[k] <= v < best[k]] + [best[k]]
        return list(range(up_to(least[k], o.step(k)), best[k], o.step(k))) + [best[k]]

    for _ in range(passes):
        before = list(best)
        for k in (0, 1):
            if o.fixed[k] or not holds(best):
                continue
            able, low, high = sides(k), 0, len(sides(k)) - 1
            while low < high:
                middle = (low + high) // 2
                tried = list(best)
                tried[k] = able[middle]
                low, high = (low, middle) if holds(tried) else (middle + 1, high)
            best[k] = able[high]
        if best == before:
            break
    return replace(o, width=best[0], height=best[1])


def page_size(o: FlowOptions, content: tuple[int, int], alone: bool) -> tuple[int, int]:
    """A page's final size: a page that is alone shrinks to its content, rounded up as the constraint asks, or down where that would exceed the largest page, but never below the content."""
    limits = o.width, o.height
    if not alone:
        return limits
    size = [limits[k] if o.fixed[k] else content[k] + o.border for k in (0, 1)]
    size = [max(size)] * 2 if o.square else size
    out = []
    for k, v in enumerate(size):
        if not o.fixed[k]:
            wanted = 1 << (v - 1).bit_length() if o.constraint == "pot" else up_to(v, o.step(k))
            below = 1 << (limits[k].bit_length() - 1) if o.constraint == "pot" else limits[k] // o.step(k) * o.step(k)
            v = wanted if wanted <= limits[k] else max(below, v)
        out.append(max(v, 1))
    return out[0], out[1]


def grouped(df: DataFrame, group: str, columns: list[str], place: Callable[[list[tuple]], list[tuple]], schema: str = PLACED, more: tuple[str, ...] = ()) -> DataFrame:
    """place() of the rows of each group, in columns; its tuples become rows of group and schema."""

    def run(part: pa.Table) -> pa.Table:
        name = part.column(group)[0]
        placed = place(list(zip(*(part.column(c).to_pylist() for c in columns), strict=True)))
        kinds = KINDS | {m: pa.int64() for m in more}
        return pa.table({group: pa.repeat(name, len(placed))} | {n: pa.array((p[k] for p in placed), kind, size=len(placed)) for k, (n, kind) in enumerate(kinds.items())})

    return df.select(group, *columns).groupBy(group).applyInArrow(run, f"{group} {dict(df.dtypes)[group]}, {schema}")


ITEM = ["ord", "id", "w", "h"]


def pack(df: DataFrame, group: str, how: str, options: FlowOptions = FlowOptions()) -> DataFrame:
    """group and the placement of each item of df (id, w, h, ord); how: rows, maxrects or guillotine.

    Each group is a page set of its own. An item that no page can hold is an error that names it.
    """
    return grouped(df, group, ITEM, lambda rows: placed_as(rows, how, options))


def best_rows(df: DataFrame, group: str, options: FlowOptions = FlowOptions()) -> DataFrame:
    """pack(how rows) under each of ten orders, and of each group the tightest: fewest pages, then least area of extents; the first tried wins ties."""
    return pack(df, group, "rows", replace(options, order="best"))


#: Passes of the size search by mode.
MODES = {"fast": 0, "good": 1, "best": 4}


def pack_pages(df: DataFrame, group: str, how: str = "maxrects", options: FlowOptions = FlowOptions(score="best"), mode: str = "good") -> DataFrame:
    """The whole placement: pack() with checks that name what can't fit, a search for the smallest page, and each page's final width and height.

    Only groups that take one page are searched, in the sides that aren't fixed. Pages of other groups keep the given size.
    Of rows with null sizes or ids none may be present; an empty table gives no rows.
    """
    o = options

    def place(rows: list[tuple]) -> list[tuple]:
        pad = 2 * o.padding
        check([(i, w + pad, h + pad) for _, i, w, h in rows], o)
        own = smallest(rows, how, o, MODES[mode]) if MODES[mode] and not all(o.fixed) else o
        placed = placed_as(rows, how, own, None if own == o else 1)
        alone = max(p[1] for p in placed) == 0
        ends = extents(placed)
        sizes = {page: page_size(o, content, alone) for page, content in ends.items()}
        return [(*p, *sizes[p[1]]) for p in placed]

    # A search takes long however few rows a group has, so groups are dealt out by number: by their bytes alone they would meet in a task or two.
    spread = df.select(group, *ITEM).repartition(8 * df.sparkSession.sparkContext.defaultParallelism, group)
    return grouped(spread, group, ITEM, place, SIZED, ("page_w", "page_h"))


def manual_rows(items: list[tuple[str, int, int, int | None, int | None]], o: FlowOptions, step: int = 0) -> list[Placed]:
    """Items (id, padded w and h, wanted x and y or null): those with a wish where they wish, the others in rows under the lowest of them.

    Items go by descending area, then descending id. A wish counts from the border on; it is moved into the page, then to
    the next multiple of the alignment or, where that leaves the page, to the one before.
    """
    check([i[:3] for i in items], o)
    items = sorted(items, key=lambda i: (i[1] * i[2], i[0]), reverse=True)
    wishes = [i for i in items if None not in i[3:]]
    wished = []
    if wishes:
        size, want = (np.array([i[a:b] for i in wishes], np.int64) for a, b in ((1, 3), (3, 5)))
        room = np.array(o.inner) - o.border - size  # the farthest place that a wish may name
        want = np.clip(want, 0, room)
        over = (o.up(o.border + want) > o.border + room).any(axis=1, keepdims=True)
        spot = np.where(over, o.border + (want // o.align * o.align if o.align > 1 else want), o.up(o.border + want))
        wished = [(name, 0, int(x), int(y), w, h, False) for (name, w, h, _, _), (x, y) in zip(wishes, spot, strict=True)]
    low = max((y + h for _, _, _, y, _, h, _ in wished), default=o.border)
    return wished + rows_of([i[:3] for i in items if None in i[3:]], o, max(low, o.border), step)


def pack_manual(df: DataFrame, group: str, options: FlowOptions = FlowOptions(), step: int = 0) -> DataFrame:
    """pack() for items (id, w, h, want_x, want_y) of which some say where they want to be."""
    pad = 2 * options.padding
    return grouped(df, group, ["id", "w", "h", "want_x", "want_y"], lambda rows: manual_rows([(i, w + pad, h + pad, x, y) for i, w, h, x, y in rows], options, step))


def smallest_page(df: DataFrame, group: str, sides: list[int], options: FlowOptions = FlowOptions()) -> DataFrame:
    """The free-rectangle placement of each group on the smallest page, of the given sides, that holds it whole: group, width, height and the placement.

    Sizes are tried by area, then circumference, then width, until one holds all; those that the items' area or largest
    side rules out aren't. Groups that no page holds are left out.
    """
    sizes = sorted(((w, h) for w in sides for h in sides), key=lambda s: (s[0] * s[1], s[0] + s[1], s[0]))

    def place(rows: list[tuple]) -> list[tuple]:
        for width, height in sizes:
            o = replace(options, width=width, height=height)
            items = ordered(rows, o)
            a, b = o.inner[0] - o.border, o.inner[1] - o.border
            if sum(w * h for _, w, h in items) > a * b or any(min(w, h) > min(a, b) or max(w, h) > max(a, b) for _, w, h in items):
                continue
            try:
                if (placed := free_rectangles(items, o, False, 1)) is not None:
                    return [(*p, width, height) for p in placed]
            except ValueError:
                continue
        return []

    found = grouped(df, group, ITEM, place, f"{PLACED}, width bigint, height bigint", ("width", "height"))
    return found.select(group, F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), *KINDS)
