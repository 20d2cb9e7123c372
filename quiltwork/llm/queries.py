"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltwork.llm.chat import CONTROL, examples, probe, read_back
from quiltwork.llm.common import documents
from quiltwork.llm.fingerprints import compare_with_edits
from quiltwork.llm.hash_index import nearest
from quiltwork.llm.hyperminhash import NearOptions, near_duplicates
from quiltwork.llm.merkle import manifest
from quiltwork.llm.mixing import plan_mix
from quiltwork.llm.noisy_channel import score_held_out
from quiltwork.llm.phrase_automata import remove_phrases
from quiltwork.llm.piece_codec import encode_documents
from quiltwork.llm.string_kernel import identify_held_out
from quiltwork.llm.suffix_merge import remove_earlier
from quiltwork.llm.surrogates import replace_entities
from quiltwork.llm.whitening import whitened_rows

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text."""
    return compare_with_edits(documents(spark, sf_dir))


def op2_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 35 words that start anywhere else."""
    return remove_phrases(documents(spark, sf_dir))


def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op4_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that an earlier document has."""
    return remove_earlier(documents(spark, sf_dir))


def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of them."""
    return identify_held_out(documents(spark, sf_dir))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data, and of what kinds they are."""
    found = replace_entities(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("_entities").cast("long").alias("n_entities"), F.array_join(F.col("_entities.kind"), ",").alias("kinds"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, decoded text and source spans, as digests."""
    return encode_documents(documents(spark, sf_dir), PIECE_MODEL, ids=False)


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates by two-word shingles."""
    return near_duplicates(documents(spark, sf_dir), NearOptions(shingle=2))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of all documents; shards, epochs and places say where the splitting tree dealt each time that a document is taken."""
    copies = [F.col(f"copies.{c}").alias(f"{c}s") for c in ("shard", "epoch", "place")]
    return plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", *copies)


def op10_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from two thirds of the labels."""
    return score_held_out(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first 16 components of the distinct vectors' covariance."""
    return whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots, proof, and the root that its proof leads to after some were tampered with."""
    return manifest(documents(spark, sf_dir))


def op13_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as its examples tell it."""
    return read_back(examples(probe(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_phrase_automata": op2_phrase_automata,
    "op3_multi_index_hashing": op3_multi_index_hashing,
    "op4_suffix_merge": op4_suffix_merge,
    "op5_string_kernel": op5_string_kernel,
    "op6_surrogates": op6_surrogates,
    "op7_piece_codec": op7_piece_codec,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_mixing": op9_mixing,
    "op10_noisy_channel": op10_noisy_channel,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_prefix_targets": op13_prefix_targets,
}

#: Words of a text, whole and unchanged.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _merkle_sql(source_levels: int = 5, top_levels: int = 4) -> str:
    """The manifest level by level, for sources of up to 16 ** source_levels rows and 16 ** top_levels sources."""
    told = lambda v: f"coalesce(CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(told(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
    parts = [
        f"""d AS (SELECT *, CASE WHEN {crc} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents)""",
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('other')} AS other FROM d)",
        "w0 AS (SELECT doc_id, source AS tree, leaf, other AS node, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves)",
        "l0 AS (SELECT tree, p, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM w0)",
    ]

    def level(k: int) -> None:
        parts.append(f"r{k} AS (SELECT tree, p // 16 AS run, any_value(n) AS n, list(h ORDER BY p) AS hs FROM l{k} GROUP BY tree, p // 16)")
        parts.append(f"l{k + 1} AS (SELECT tree, run AS p, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM r{k})")
        sides = [f"array_to_string(hs[{x}], '')" for x in ("1 : p % 16", "p % 16 + 2 : 16")]
        sides[0] = f"CASE WHEN p % 16 = 0 THEN '' ELSE {sides[0]} END"
        parts.append(f"s{k} AS (SELECT w.*, r.n, {sides[0]} AS a, {sides[1]} AS b FROM w{k} w JOIN r{k} r ON r.tree IS NOT DISTINCT FROM w.tree AND r.run = w.p // 16)")
        more = "" if k < source_levels else ", subroot"
        parts.append(f"w{k + 1} AS (SELECT doc_id, tree, leaf, CASE WHEN n = 1 THEN node ELSE sha256(a || node || b) END AS node, proof || a || b AS proof, p // 16 AS p{more} FROM s{k})")

    for k in range(source_levels):
        level(k)
    k = source_levels
    # The sources' roots become the nodes of one tree.
    parts.append(f"tops AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS p FROM l{k})")
    parts[-1:] = [parts[-1], f"l{k + 1} AS (SELECT 0 AS tree, p, subroot AS h, count(*) OVER () AS n FROM tops)"]
    parts.append(f"w{k + 1} AS (SELECT doc_id, 0 AS tree, leaf, node, proof, t.p, subroot FROM w{k} w JOIN tops t ON t.source IS NOT DISTINCT FROM w.tree)")
    for k in range(source_levels + 1, source_levels + 1 + top_levels):
        level(k)
    k = source_levels + 1 + top_levels
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = h AS verified FROM w{k}, l{k}"


#: A text with its backslashes and control strings escaped.
_ESCAPED = "regexp_replace(replace({}, '\\', '\\\\'), '([<\\[])(" + "|".join(re.sub(r"([\[\]|])", r"\\\1", c[1:]) for c in CONTROL) + r")', '\1\\\2', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op2_phrase_automata": rf"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35),
        windows AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM starts),
        again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows WHERE s IN (SELECT s FROM again)),
        places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
        kept AS (
            SELECT p.doc_id, count(g.i) AS n_removed, string_agg(p.word, ' ' ORDER BY p.i) FILTER (g.i IS NULL) AS text
            FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(k.text, '')) AS kept_sha256
        FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op4_suffix_merge": """
        WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
        starts AS (SELECT doc_id, i, substring(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(n - 49, 0))) AS i FROM docs)),
        least AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
        hits AS (SELECT doc_id, i FROM starts JOIN least USING (s) WHERE first < doc_id),
        bytes AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) - 1 AS i FROM (SELECT doc_id, regexp_extract_all(x, '..') AS h FROM docs)),
        marked AS (
            SELECT b.doc_id, b.h, b.i, coalesce(b.i - max(t.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS UNBOUNDED PRECEDING) < 50, false) AS gone
            FROM bytes b LEFT JOIN hits t ON t.doc_id = b.doc_id AND t.i = b.i),
        edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked),
        kept AS (
            SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(h, '' ORDER BY i) FILTER (NOT gone) AS x
            FROM edges GROUP BY doc_id)
        SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            sha256(unhex(coalesce(k.x, ''))) AS kept_sha256
        FROM docs d LEFT JOIN kept k USING (doc_id)""",
    "op8_hyperminhash": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
        sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON s.a = r.b),
        least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.b, d.doc_id) AS kept
        FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN least l USING (doc_id)""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_prefix_targets": rf"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text)) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM said),
        sizes AS (SELECT *, length('<|im_start|>' || replace({_ESCAPED.format("role")}, chr(10), '\n') || ' ' || {_ESCAPED.format("text")} || '<|im_end|> ') AS chars FROM turns),
        sums AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM sizes)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(so_far) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
        FROM sums GROUP BY conv_id""",
}
