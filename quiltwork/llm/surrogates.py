"""Replaces personal data and secrets by surrogates, in DataFrame functions only.

Detected entities get keyed, type-consistent replacements: signs and separators stay, digits become digits, letters become
letters of the same script and case, addresses stay valid, card numbers keep the issuer's digit and a right or wrong check
digit, given names become given names of the same gender and script. The replacement depends on the key and the entity
alone, so mentions of one entity agree across documents whatever their spelling (case, separators); collision checks over
all entities of the table make sure that two entities never share one and that no replacement is itself an entity.
"""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltwork.llm.common import materialise

# Given names by gender and script.
GIVEN = {
    "f-latin": ["Patricia", "Jennifer", "Elizabeth", "Barbara", "Susanne", "Jessica", "Margaret", "Kimberly", "Michelle", "Dorothy", "Charlotte", "Katharina", "Valentina", "Guadalupe", "Gabriela", "Brigitte", "Veronique", "Ingeborg"],
    "m-latin": ["Robert", "Michael", "William", "Richard", "Joseph", "Thomas", "Charles", "Christopher", "Matthew", "Anthony", "Jürgen", "Wolfgang", "Alejandro", "Francisco", "Guillermo", "Philippe", "François", "Sebastian"],
    "f-cyrillic": ["Мария", "Наталья", "Светлана", "Екатерина", "Татьяна", "Людмила", "Галина", "Ирина"],
    "m-cyrillic": ["Александр", "Дмитрий", "Сергей", "Владимир", "Николай", "Михаил", "Алексей", "Андрей"],
    "f-greek": ["Μαρία", "Ελένη", "Κατερίνα", "Βασιλική", "Σοφία", "Αγγελική"],
    "m-greek": ["Γιώργος", "Δημήτρης", "Κωνσταντίνος", "Νικόλαος", "Ιωάννης", "Παναγιώτης"],
}
# Forms of address before a name.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа", "Κύριος", "Κυρία"]

LETTER = r"[\p{L}]"
NAME_WORD = r"\p{Lu}[\p{Ll}'’]{1,64}+(?:-\p{Lu}\p{Ll}{1,64}+)?"
_GIVEN = "|".join(sorted((n for names in GIVEN.values() for n in names), key=lambda n: (-len(n), n)))
#: Kinds in the order in which they are tried. Whatever repeats has a bound (an address's parts those of the mail standards),
#: and groups are possessive: Java's matcher recurses once a repeat of a group, and a few thousand would overflow its stack.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,256}+@[\p{L}\p{N}\-]{1,63}+(?:\.[\p{L}\p{N}\-]{1,63}+){1,126}+",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    "ipv4": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "key": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,512}+|sk-[0-9A-Za-z\-_]{16,512}+|xox[bap]-[0-9A-Za-z\-]{10,512}+|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:(?:{'|'.join(TITLES)})\.? ){{1,8}}+(?:{NAME_WORD} )?{NAME_WORD}|(?:{_GIVEN}) {NAME_WORD})(?![\p{{L}}\p{{N}}])",
}
#: Any of them. None begins within a word, which is said once and first, so most places of a text are done with at once.
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Country codes; those that aren't listed have three digits.
CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Rounds of new replacements for entities whose replacement collided; each leaves a small part of those before. After so
#: many, forms with too few values for all entities get one more character every fourth round.
ROUNDS = 12


@dataclass(frozen=True)
class SurrogateOptions:
    """key is a secret: whoever has it can tell which replacement an entity gets."""

    key: str = "change me"


def given_names(key: str) -> dict[str, str]:
    """Each given name's replacement: the next of the same gender and script in keyed order, so none is shared or kept."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def kind_of(mention: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        found = F.when(mention.rlike(f"^(?:{pattern})$"), kind).otherwise(found)
    return found


def normal(kind: Column, text: Column) -> Column:
    """What makes two mentions one entity: letters and digits in lower case, of phones with the + before a country code; of addresses the whole."""
    plain = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.when(kind.isin("ipv4", "ipv6", "email"), F.lower(text)).when((kind == "phone") & text.startswith("+"), F.concat(F.lit("+"), plain)).otherwise(plain)


def random_byte(digest: Column, i: Column) -> Column:
    """Byte i of 64 from a hex digest, going round."""
    return F.conv(F.substring(digest, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(alphabet: str, byte: Column) -> Column:
    return F.substring(F.lit(alphabet), byte % len(alphabet) + 1, F.lit(1))


def letters_like(text: Column, digest: Column) -> Column:
    """Digits for digits and letters for letters of the same script; other characters stay."""

    def one(ch: Column, i: Column) -> Column:
        byte = random_byte(digest, i)
        return (
            F.when(ch.rlike("[0-9]"), pick("0123456789", byte)).when(ch.rlike(r"\p{IsLatin}"), pick("abcdefghijklmnopqrstuvwxyz", byte))
            .when(ch.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшщыэюя", byte)).when(ch.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω", byte))
            .when(ch.rlike(r"\p{IsHan}"), pick("安保成大方光和华建江立林明平清仁荣瑞山石书天文新信义英永元正志中", byte)).otherwise(ch)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def hex_like(text: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda ch, i: F.when(ch.rlike("[0-9a-f]"), pick("0123456789abcdef", random_byte(digest, i))).otherwise(ch)), "")


def luhn(digits: Column) -> Column:
    """The check sum modulo 10, the last digit being the check digit."""
    values = F.reverse(F.transform(F.split(digits, ""), lambda d: d.cast("int")))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(values, lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10


def card_like(text: Column, digest: Column) -> Column:
    n = F.char_length(text)
    body = F.concat(F.substring(text, 1, 1), F.substring(letters_like(text, digest), F.lit(2), n - 2))
    check = (10 - luhn(F.concat(body, F.lit("0")))) % 10
    wrong = (check + 1 + random_byte(digest, F.lit(60)) % 9) % 10
    return F.concat(body, F.when(luhn(text) == 0, check).otherwise(wrong).cast("string"))


def family_like(text: Column, digest: Column) -> Column:
    """Syllables of the name's script, as long as the name (three letters at least)."""

    def syllables(consonants: str, vowels: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.concat(pick(consonants, random_byte(digest, 2 * i)), pick(vowels, random_byte(digest, 2 * i + 1)))), "")

    n = F.least(F.greatest(F.char_length(text), F.lit(3)), F.lit(32))
    spelled = F.when(text.rlike(r"\p{IsCyrillic}"), syllables("бвгдзклмнпрст", "аеиоу")).when(text.rlike(r"\p{IsGreek}"), syllables("βγδζκλμνπρστ", "αειου")).otherwise(syllables("bdfghklmnprstvw", "aeiou"))
    return F.substring(spelled, F.lit(1), n)


def email_like(text: Column, digest: Column, domain_digest: Column) -> Column:
    """The name before @ by its own, the domain by the domain alone, so that a domain's addresses stay together; the last label stays."""
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    last = F.substring_index(domain, ".", -1)
    return F.concat(letters_like(local, digest), F.lit("@"), letters_like(F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(last)), domain_digest), last)


def propose(kind: Column, norm: Column, round_: Column, key: str) -> Column:
    """The replacement of a normal form that a round proposes; a phone's country code stays."""
    extra = F.repeat(F.lit("0"), F.greatest(F.floor((round_ - ROUNDS) / 4) + 1, F.lit(0)).cast("int"))
    norm = F.when(kind == "email", F.concat(extra, norm)).when(kind.isin("ipv4", "ipv6"), norm).otherwise(F.concat(norm, extra))
    code = F.regexp_extract(norm, CODE, 0)
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, round_.cast("string")), 512)
    domain = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.substring_index(norm, "@", -1)), 512)
    octets = F.array_join(F.transform(F.split(norm, r"\."), lambda _, i: (random_byte(digest, i) % 254 + 1).cast("string")), ".")
    phone = letters_like(norm, digest)
    return (
        F.when(kind == "email", email_like(norm, digest, domain)).when(kind == "ipv4", octets).when(kind == "ipv6", hex_like(norm, digest)).when(kind == "card", card_like(norm, digest))
        .when(kind == "family", family_like(norm, digest)).when((kind == "key") & norm.rlike("^[0-9a-f]+$"), hex_like(norm, digest)).when(kind == "key", F.concat(F.regexp_extract(norm, "^(akia|gh[pousr]|sk|xox[bap])", 1), F.substring(letters_like(norm, digest), F.char_length(F.regexp_extract(norm, "^(akia|gh[pousr]|sk|xox[bap])", 1)) + 1, F.char_length(norm))))
        .when(kind == "iban", F.concat(F.substring(norm, 1, 2), F.substring(phone, F.lit(3), F.char_length(norm))))
        .when((kind == "phone") & (code != ""), F.concat(code, F.substring(phone, F.char_length(code) + 1, F.char_length(norm)))).otherwise(phone)
    )


def settle(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, surrogate for distinct entities (kind, norm).

    Round by round, entities without a replacement propose one; a proposal holds if no entity has it as normal form or
    replacement and if, among those that propose it now, the entity has the least normal form. The rounds go on only as
    long as any is left.
    """
    left, settled, taken, k = materialise(entities), None, None, 0
    while True:
        proposed = materialise(left.withColumn("surrogate", propose(F.col("kind"), F.col("norm"), F.lit(k), key)))
        winner = proposed.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        winner = winner.join(entities.select("kind", F.col("norm").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            winner = winner.join(taken, ["kind", "surrogate"], "left_anti")
        winner = materialise(winner.select("kind", "norm", "surrogate"))
        settled = winner if settled is None else settled.union(winner)
        taken = settled.select("kind", "surrogate")
        left = materialise(left.join(winner.select("kind", "norm"), ["kind", "norm"], "left_anti"))
        if left.isEmpty():
            return settled
        k += 1


def dress(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The replacement of a normal form in the spelling of a mention: its separators and capitals. Its normal form is the replacement, so what was checked is what is written."""
    surrogate = F.regexp_replace(surrogate, r"^\+", "")
    plain = kind.isin("email", "ipv4", "ipv6")

    def place(ch: Column, i: Column) -> Column:
        nth = F.when(plain, i + 1).otherwise(F.char_length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")))
        new = F.substring(surrogate, nth, F.lit(1))
        return F.when(~plain & ~ch.rlike(r"[\p{L}\p{N}]"), ch).when(ch.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)

    spelled = F.concat(F.array_join(F.transform(F.split(mention, ""), place), ""), F.when(plain, F.substring(surrogate, F.char_length(mention) + 1, F.lit(64))).otherwise(F.substring(surrogate, F.char_length(F.regexp_replace(mention, r"[^\p{L}\p{N}]", "")) + 1, F.lit(64))))
    return F.when(kind == "ipv4", surrogate).when((kind == "key") & ~mention.rlike(r"\p{Ll}"), F.upper(spelled)).when((kind == "family") & ~mention.rlike(r"\p{Ll}"), F.upper(surrogate)).when(kind == "family", F.initcap(surrogate)).otherwise(spelled)


def replace_entities(docs: DataFrame, options: SurrogateOptions = SurrogateOptions(), text_col: str = "text") -> DataFrame:
    """docs with text replaced and one more column, _entities: array of (kind, surrogate) in order of appearance.

    Null texts stay null, with no entities; texts without entities pass unchanged and are not shuffled. The replacement is
    the same for repeated rows. Other columns stay as they are, whatever their names; a column _entities is replaced.
    """
    given = given_names(options.key)
    names = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
    docs = docs.drop("_entities")
    text, nothing = F.col(text_col), F.expr("cast(array() as array<struct<kind:string,surrogate:string>>)")
    clean = docs.where(F.coalesce(~text.rlike(ANY), F.lit(True))).withColumn("_entities", nothing)
    # Texts with entities are few; they are found once and kept. The row is one column, so that its names can't clash.
    hit = docs.where(text.rlike(ANY)).select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text.alias("_text"), F.sha2(text, 256).alias("_key"))
    found = materialise(hit.withColumn("_mentions", F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))))
    text = F.col("_text")

    mentions = found.select("_key", F.explode(F.array_distinct("_mentions")).alias("mention")).distinct().withColumn("kind", kind_of(F.col("mention")))
    word = F.explode(F.when(F.col("kind") == "name", F.split("mention", " ")).otherwise(F.array("mention"))).alias("part")
    part = F.col("part")
    is_name = F.col("kind") == "name"
    title = is_name & F.regexp_replace(part, r"\.$", "").isin(*TITLES)
    parts = mentions.select("_key", "kind", word).distinct().where(~title)
    parts = parts.withColumn("kind", F.when(is_name & names[part].isNotNull(), "given").when(is_name, "family").otherwise(F.col("kind"))).withColumn("norm", normal(F.col("kind"), part))
    parts = materialise(parts)
    table = settle(parts.where(F.col("kind") != "given").select("kind", "norm").distinct(), options.key)
    dressed = parts.join(table, ["kind", "norm"], "left").select("_key", "part", F.struct("kind", F.when(F.col("kind") == "given", names[part]).otherwise(dress(part, F.col("kind"), F.col("surrogate"))).alias("surrogate")).alias("to"))
    # Bounded by the parts of one text.
    maps = dressed.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("part", "to"))).alias("_map"))
    # Texts that mention titles alone have no map, and stay.
    known = found.join(maps, "_key", "left")

    def to(mention: Column) -> Column:
        whole = F.get(F.array(F.element_at(F.col("_map"), mention)), F.lit(0))
        split = F.array_join(F.transform(F.split(mention, " "), lambda w: F.coalesce(F.element_at(F.col("_map"), w)["surrogate"], w)), " ")
        return F.when(whole.isNotNull(), F.struct(whole["kind"].alias("kind"), whole["surrogate"].alias("surrogate"))).otherwise(F.struct(F.lit("name").alias("kind"), split.alias("surrogate")))

    known = known.withColumn("_entities", F.transform("_mentions", to))
    pieces = F.zip_with(F.split(text, ANY, -1), F.col("_entities"), lambda before, e: F.concat(before, F.coalesce(e["surrogate"], F.lit(""))))
    columns = [F.array_join(pieces, "").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return clean.select(*docs.columns, "_entities").union(known.select(*columns, "_entities"))
