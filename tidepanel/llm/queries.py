"""Registered queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.llm import (
    byte_bpe, chat_format, collocations, decontaminate, line_dedup, lz_fingerprint, near_dedup, packing, prefix_trie, quality, secret_scan,
    sharding, suffix_dedup,
)
from tidepanel.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


CLOSING_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(CLOSING_TURNS, "conv_id bigint, turn bigint, role string, text string")
    back = chat_format.read_back(chat_format.expand(given.unionByName(planted)))
    digest = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


# Sizes of the template: <s>[INST] + [/INST] + </s> are 20 characters.
_SQL_ESCAPED = "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
ORACLES["op2_chat_format"] = f"""
WITH every_turn AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, sum(20 + length({_SQL_ESCAPED.format('role')}) + length({_SQL_ESCAPED.format('text')})) OVER w AS upto,
         row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM every_turn WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR place = n), 0) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


@lru_cache(maxsize=4)
def public_tokenizer(name: str = "byte_bpe_50k.tiktoken") -> byte_bpe.Tokenizer:
    import public_tokenizers

    return byte_bpe.Tokenizer.from_rank_file(public_tokenizers.path(name), public_tokenizers.PATTERN)


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizer())


@query
def op5_two_pass_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``. The shards are written with their texts and the digests read from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = "coalesce(octet_length(text), 0) + 1"
    shards, _ = sharding.shuffle_into_shards(docs, ["doc_id"], size)
    return shards.select(
        "doc_id", F.expr(size).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_line_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_spread_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    return done.select(
        "doc_id", "n_lines", "n_removed", F.char_length(text).cast("bigint").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256")
    )


ORACLES["op8_line_sites"] = f"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS source, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
spread AS (
  SELECT trim(raw, ' ') AS line, min({{'d': doc_id, 'p': pos}}) AS first
  FROM split WHERE trim(raw, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {line_dedup.SITES}),
judged AS (
  SELECT s.doc_id, s.pos, s.raw, first IS NULL OR first = {{'d': s.doc_id, 'p': s.pos}} AS stays
  FROM split s LEFT JOIN spread ON trim(s.raw, ' ') = line),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (stays), '') AS text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       length(coalesce(k.text, '')) AS kept_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)"""


@query
def op9_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    return quality.classify(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


@query
def op4_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    def of_kind(k: int) -> Column:
        return F.size(F.filter("base", lambda b: b["kind"] == k)).cast("bigint")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(secret_scan.KINDS[:3])]
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.as_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.as_text(F.concat("base", "found")).alias("spans"),
    )


@query
def op6_winnow_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    done = decontaminate.measure(docs.select("doc_id", "text"), items)
    return done.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated"
    )


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
ORACLES["op6_winnow_decontamination"] = f"""
WITH dw AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
iw AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM iw),
item_windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS words
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM iw)),
doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS words
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM doc_windows JOIN item_windows USING (m, words)),
spots AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS spot FROM hits) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(spots.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, spots.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query
def op7_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked at 85/100."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Fraction(85, 100))


@query
def op10_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest_only=True)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("text_bytes").cast("string").alias("kept_sha256"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.share_openings(table(spark, sf_dir, "conversations")))


# DuckDB has no crc32: the digits go through its state one after the other.
ORACLES["op11_prefix_trie"] = f"""
WITH RECURSIVE own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
digits AS (
  SELECT conv_id, 4294967295::BIGINT AS state, CAST(conv_id AS VARCHAR) AS rest FROM own
  UNION ALL
  SELECT conv_id, list_reduce([xor(state, ascii(rest[1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
           lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), rest[2:]
  FROM digits WHERE rest <> ''),
shared AS (SELECT conv_id, xor(state, 4294967295) % 4 AS h FROM digits WHERE rest = ''),
rebuilt AS (
  SELECT o.conv_id, coalesce(b.turns, [])[1:h] || o.turns[h + 1:] AS turns
  FROM own o JOIN shared USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
prefixes AS (SELECT conv_id, turns, d, turns[1:d] AS node FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = d), '')) AS ends_sha256,
         CASE WHEN d > 0 THEN len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM prefixes GROUP BY node, d),
edges AS (
  SELECT c.node, c.d, p.conv_id AS parent_conv_id, p.node AS parent FROM nodes c JOIN nodes p ON p.d = c.d - 1 AND p.node = c.node[1:c.d - 1]),
widths AS (SELECT parent AS node, count(*) AS n_children FROM edges GROUP BY 1),
below AS (
  SELECT t.node, sum((s.n_convs - 1) * s.words) AS saved_tokens, count(*) FILTER (w.node IS NULL) AS n_leaves
  FROM nodes s LEFT JOIN widths w ON w.node = s.node JOIN nodes t ON t.d <= s.d AND t.node = s.node[1:t.d] GROUP BY 1)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes JOIN below USING (node) LEFT JOIN widths USING (node) LEFT JOIN edges USING (node, d)"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
counts AS (
  SELECT lang, m, phrase, count(*) AS f
  FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
        FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM worded, range(1, 6) AS sizes(m) WHERE len(w) >= m))
  GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM candidates, range(2, 5) AS sizes(k) WHERE k < m) GROUP BY ALL),
free AS (SELECT c.* FROM candidates c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM (SELECT *, unnest(range(1, m)) AS k FROM free)),
scored AS (
  SELECT lang, cuts.phrase, a, x.f AS l, y.f AS r, n, k, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN counts x USING (lang) JOIN counts y USING (lang) JOIN totals USING (lang)
  WHERE x.phrase = p1 AND y.phrase = p2),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM weakest
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000"""


@query
def op13_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch",
    )
