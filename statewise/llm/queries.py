"""Registered queries of the corpus operators, each over its whole table, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, infill, jaccard_join, merkle, mixing, quality_crf, quality_rules, secret_scan, sharding, simhash, suffix_dedup, token_counts

#: File of the production vocabulary among the public tokenizers.
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op3_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_groups(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_rules.repetition_report(_table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = quality_crf.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality_crf.score(docs, field)
    return scored.select("doc_id", quality_crf.in_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_preferences(*chat_format.reply_pairs(_table(spark, sf_dir, "conversations")))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    upper = "".join(map(chr, range(65, 91)))
    tampered = F.when(F.crc32(docs["doc_id"].cast("string")) % 5 == 0, F.translate(docs["text"], upper, upper.lower()))
    made = merkle.manifest(docs, changed=tampered).withColumn("folded_root", merkle.folded(F.col("changed_leaf"), F.col("path")))
    proof = F.sha2(F.array_join(F.transform("path", lambda at: at["siblings"]), ""), 256)
    return made.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.restore(infill.fill_in_middle(_table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_dedup, op2_jaccard_join, op3_bin_packing, op4_mixing, op5_secret_scan, op6_quality_rules, op7_decontamination, op8_quality_crf, op9_token_counts, op10_chat_format)
    return {f.__name__: f for f in (*found, op11_simhash, op12_merkle_manifest, op13_fill_in_middle)}


_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_SHINGLES = "CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')] ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END"

_OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS a FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct({_SHINGLES})) AS s FROM w),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b WHERE 9 * k >= 4 * (len(x.s) + len(y.s))),
reach(id, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.o = l.a),
same AS (SELECT s, min(doc_id) AS rep_id, count(*) AS n FROM sets WHERE len(s) > 0 GROUP BY s)
SELECT t.doc_id, c.class_id, coalesce(same.rep_id, t.doc_id) AS rep_id, coalesce(same.n, 1) AS n_copies,
       coalesce(n.n_links, 0) AS n_links, len(t.s)::BIGINT AS n_shingles
FROM sets t JOIN (SELECT id, min(o) AS class_id FROM reach GROUP BY id) c ON c.id = t.doc_id
LEFT JOIN same ON same.s = t.s LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON n.a = t.doc_id
"""

_LIMITS = quality_rules.RuleLimits()
_OP6 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS a FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM t),
held AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) FILTER (again) AS n, coalesce(sum(length(array_to_string({_WORDS.format(text="line")}, ''))) FILTER (again), 0) AS chars FROM held GROUP BY doc_id),
w AS (SELECT doc_id, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS i FROM t),
g AS (SELECT w.doc_id, i, length(word) AS chars, a[i:i+2] AS g3, len(a) - i + 1 AS room, a[i:i+4] AS g5, a[i:i+6] AS g7, a[i:i+9] AS g10 FROM w JOIN t USING (doc_id)),
f AS (SELECT doc_id, i, chars,
  room >= 3 AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3,
  room >= 5 AND row_number() OVER (PARTITION BY doc_id, g5 ORDER BY i) > 1 AS r5,
  room >= 7 AND row_number() OVER (PARTITION BY doc_id, g7 ORDER BY i) > 1 AS r7,
  room >= 10 AND row_number() OVER (PARTITION BY doc_id, g10 ORDER BY i) > 1 AS r10 FROM g),
c AS (SELECT doc_id, chars,
  bool_or(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
  bool_or(r5) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5,
  bool_or(r7) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS c7,
  bool_or(r10) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10 FROM f),
m AS (SELECT doc_id, count(*) AS n_words, sum(chars) AS word_chars, count(*) FILTER (c3) AS n_repeat_words,
  coalesce(sum(chars) FILTER (c5), 0) AS s5, coalesce(sum(chars) FILTER (c7), 0) AS s7, coalesce(sum(chars) FILTER (c10), 0) AS s10 FROM c GROUP BY doc_id),
r AS (SELECT t.doc_id, coalesce(m.n_words, 0)::BIGINT AS n_words, coalesce(m.word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(t.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(m.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup.chars, 0) AS line_chars, s5, s7, s10
  FROM t LEFT JOIN m USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < {_LIMITS.min_words} OR 100 * n_repeat_words > {_LIMITS.max_repeat_words_pct} * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND line_chars <= {_LIMITS.max_dup_line_chars}::DOUBLE * word_chars AND s5 <= {_LIMITS.max_dup_ngram_chars[5]}::DOUBLE * word_chars
  AND s7 <= {_LIMITS.max_dup_ngram_chars[7]}::DOUBLE * word_chars AND s10 <= {_LIMITS.max_dup_ngram_chars[10]}::DOUBLE * word_chars
  AND n_symbols <= {_LIMITS.max_symbols_per_word}::DOUBLE * n_words AND word_chars <= {_LIMITS.max_word_chars}::DOUBLE * n_words AS kept
FROM b
"""

_OP7 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS a FROM documents),
v AS (SELECT item_id, {_WORDS.format(text="coalesce(text, '')")} AS a FROM benchmark),
ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest({_SHINGLES}) AS s FROM w)),
bs AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest({_SHINGLES}) AS s FROM v)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""

_OP10 = """
WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
k AS (SELECT pair_id, max(turn) AS last, arg_min(text, turn) AS reply FROM t WHERE role = 'assistant' GROUP BY pair_id),
j AS (SELECT t.*, k.last, o.reply AS other, coalesce(t.turn = k.last AND t.role = 'assistant', false) AS is_reply
      FROM t LEFT JOIN k USING (pair_id) LEFT JOIN k o ON o.pair_id = k.pair_id + 1 WHERE coalesce(t.turn <= k.last, true)),
s AS (SELECT pair_id, turn, row_number() OVER (PARTITION BY pair_id ORDER BY turn) AS i, role, is_reply, other, text AS c_text,
      CASE WHEN is_reply THEN other ELSE text END AS r_text FROM j),
d AS (SELECT pair_id, coalesce(min(i) FILTER (r_text IS DISTINCT FROM c_text) - 1, count(*)) AS n_common, count(*) AS n, count(*) FILTER (r_text IS NOT NULL) AS m FROM s GROUP BY pair_id),
r AS (SELECT s.*, n_common, '<|' || role || '|>' || chr(10) || c_text || '<|end|>' || chr(10) AS c, '<|' || role || '|>' || chr(10) || r_text || '<|end|>' || chr(10) AS r FROM s JOIN d USING (pair_id)),
p AS (SELECT *, sum(CASE WHEN i > n_common THEN length(c) ELSE 0 END) OVER w AS c_end, sum(CASE WHEN i > n_common THEN coalesce(length(r), 0) ELSE 0 END) OVER w AS r_end
      FROM r WINDOW w AS (PARTITION BY pair_id ORDER BY i))
SELECT pair_id, d.n_common::INTEGER AS n_common, (n - d.n_common)::INTEGER AS n_chosen, (m - d.n_common)::INTEGER AS n_rejected,
  coalesce(string_agg(c, '' ORDER BY i) FILTER (i <= d.n_common), '') AS prompt, coalesce(string_agg(c, '' ORDER BY i) FILTER (i > d.n_common), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (i > d.n_common AND r IS NOT NULL), '') AS rejected,
  coalesce(string_agg((c_end - length(c) + 5 + length(role))::VARCHAR || ':' || (c_end - 1)::VARCHAR, ',' ORDER BY i) FILTER (i > d.n_common AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((r_end - length(r) + 5 + length(role))::VARCHAR || ':' || (r_end - 1)::VARCHAR, ',' ORDER BY i) FILTER (i > d.n_common AND role = 'assistant' AND r IS NOT NULL), '') AS rejected_mask
FROM p JOIN d USING (pair_id) GROUP BY pair_id, d.n_common, n, m
"""

# the polynomial division of CRC-32, bit by bit, over the bytes of a decimal number
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, range(8 * length({s}))), lambda c, i:
  CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii({s}[i // 8 + 1]) ELSE 0 END) & 1 = 1
  THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii({s}[i // 8 + 1]) ELSE 0 END) >> 1, 3988292384) ELSE xor(c, CASE WHEN i % 8 = 0 THEN ascii({s}[i // 8 + 1]) ELSE 0 END) >> 1 END))"""


def _part(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"


_HEAD = " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars"))
_OP12 = f"""
WITH RECURSIVE d AS (SELECT *, {_CRC.format(s="(doc_id::VARCHAR)")} % 5 = 0 AS hit FROM documents),
l AS (SELECT doc_id, source, sha256({_HEAD} || {_part("text")}) AS h,
  sha256({_HEAD} || {_part("CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS t FROM d),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS slot, count(*) OVER (PARTITION BY source) AS n FROM l),
up(tree, lvl, slot, h, n) AS (SELECT tree, 0, slot, h, n FROM p
  UNION ALL SELECT tree, lvl + 1, slot // 16, sha256(string_agg(h, '' ORDER BY slot)), (any_value(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY tree, lvl, slot // 16),
tops AS (SELECT tree, lvl, h FROM up WHERE n = 1),
over_(lvl, slot, h, n) AS (SELECT 0, tree, h, (SELECT count(*) FROM tops) FROM tops
  UNION ALL SELECT lvl + 1, slot // 16, sha256(string_agg(h, '' ORDER BY slot)), (any_value(n) + 15) // 16 FROM over_ WHERE n > 1 GROUP BY lvl, slot // 16),
nodes AS (SELECT tree, lvl, slot, h FROM up WHERE n > 1 UNION ALL SELECT t.tree, t.lvl + o.lvl, o.slot, o.h FROM tops t, over_ o WHERE o.n > 1),
fold(doc_id, tree, lvl, slot, acc, proof) AS (
  SELECT doc_id, tree, 0, CASE WHEN n > 1 THEN slot ELSE tree END, t, '' FROM p
  UNION ALL SELECT f.doc_id, f.tree, f.lvl + 1, CASE WHEN any_value(t.lvl) = f.lvl + 1 THEN f.tree ELSE f.slot // 16 END,
    sha256(string_agg(CASE WHEN u.slot = f.slot THEN f.acc ELSE u.h END, '' ORDER BY u.slot)), f.proof || coalesce(string_agg(u.h, '' ORDER BY u.slot) FILTER (u.slot <> f.slot), '')
  FROM fold f JOIN nodes u ON u.tree = f.tree AND u.lvl = f.lvl AND u.slot // 16 = f.slot // 16 JOIN tops t ON t.tree = f.tree GROUP BY f.doc_id, f.tree, f.lvl, f.slot, f.acc, f.proof)
SELECT p.doc_id, p.h AS leaf, t.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = r.h AS verified
FROM p JOIN tops t USING (tree) JOIN (SELECT doc_id, arg_max(acc, lvl) AS acc, arg_max(proof, lvl) AS proof FROM fold GROUP BY doc_id) f USING (doc_id), (SELECT h FROM over_ WHERE n = 1) r
"""

_OP13 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS x FROM documents),
k AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS a, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (len(a) + 1), h2 % (len(a) + 1)) AS lo, greatest(h1 % (len(a) + 1), h2 % (len(a) + 1)) AS hi FROM k),
s AS (SELECT *, array_to_string(a[1:lo], '') AS p, array_to_string(a[lo + 1:hi], '') AS m, array_to_string(a[hi + 1:], '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, len(a)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": _OP2, "op6_quality_rules": _OP6, "op7_decontamination": _OP7, "op10_chat_format": _OP10, "op12_merkle_manifest": _OP12, "op13_fill_in_middle": _OP13}
