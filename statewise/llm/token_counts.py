"""Token counts of whole texts from pre-token frequencies.

1.  Pre-tokens that the tokenizer's own list of pieces names, at most as many as
    the tokenizer has, are counted by the driver once and sent to every task.
2.  Every task counts the other pre-tokens of its texts in bounded tables; Spark
    sums them to the vocabulary, the tokenizer counts the pieces of each distinct
    pre-token once, and vocabulary and pieces are written as the dictionary.
3.  Per text the pre-token frequencies meet the dictionary.  Frequent
    pre-tokens, those whose share of all occurrences is at least their size (their
    bytes and `ENTRY` more) over `hot_bytes`, are joined in the task that reads the
    text: since shares sum to 1, their sizes sum to at most `hot_bytes`, whatever
    the corpus.  All others are joined by pre-token in a shuffle, in which none
    of them can be a hot key, and their pieces are summed per text.  Ids of a
    document are never materialised.

Texts are split twice.  Frequencies of one pass, written and read for both the vocabulary and the
join, need more disk than a pass takes time: they are nearly as large as the texts.

The rule that splits a text and the special strings are read from the tokenizer
file; a file with a rule that is not known here is an error.

Defined cases: null counts as empty (0 bytes, 0 tokens); a special string in a
text is one token, as by the library's default; repeated rows (and repeated or
null ids) each get their own result; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import over_cores, written
from .textscan import slices

#: Fixed value: the pre-token expression that the byte-level rule stands for.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: What an entry of a table in a worker takes besides the bytes of its pre-token.
ENTRY = 64


def splitting(definition: str) -> tuple[str, list[str]]:
    """(pre-token expression, special strings) of a tokenizer file's text."""
    spec = json.loads(definition)
    rule = spec.get("pre_tokenizer") or {}
    if rule.get("type") != "ByteLevel" or rule.get("add_prefix_space") or not rule.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("this tokenizer splits or normalises texts by a rule that is not known here")
    added = spec.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("this tokenizer's added strings are matched by a rule that is not known here")
    return BYTE_LEVEL, sorted((t["content"] for t in added), key=len, reverse=True)


def counter_of(definition: str) -> Callable[[str], tuple[Counter, int]]:
    """text -> (frequency of each pre-token, special strings in it)."""
    expression, special = splitting(definition)
    find = regex.compile(expression).findall
    marks = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(text: str) -> tuple[Counter, int]:
        pieces = marks.split(text) if marks is not None and marks.search(text) else [text]
        found = Counter(find(pieces[0]))
        for more in pieces[1:]:
            found.update(find(more))
        return found, len(pieces) - 1

    return count


@functools.lru_cache(maxsize=2)
def _tokenizer(definition: str):
    """The library's tokenizer, built once in a process; calls stay in the task's own thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def _lengths(definition: str, tokens: list[str]) -> list[int]:
    return [len(e) for e in _tokenizer(definition).encode_batch_fast(tokens, add_special_tokens=False)]


def named_pieces(definition: str) -> dict[str, int]:
    """Pre-tokens among the strings of the tokenizer's own pieces, and how many pieces each of them takes."""
    tokenizer, count = _tokenizer(definition), counter_of(definition)
    names = sorted({tokenizer.decode([i], skip_special_tokens=False) for i in tokenizer.get_vocab().values()})
    alone = [t for t in names if "\ufffd" not in t and count(t) == (Counter({t: 1}), 0)]
    return dict(zip(alone, _lengths(definition, alone)))


def _vocabulary(definition: str, known, most_held: int):
    """Texts -> (token, n) of pre-tokens that are not known: tables of at most about `most_held` pre-tokens, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held = counter_of(definition), Counter()

        def emit() -> pa.RecordBatch:
            found = [t for t in held if t not in known.value]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([held[t] for t in found], pa.int64())], names=["token", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text"):
                    held.update(count(text.as_py() or "")[0])
                if len(held) > most_held:
                    yield emit()
                    held.clear()
        yield emit()

    return run


def _pieces(definition: str):
    """(token, n) of distinct pre-tokens -> adds `pieces`: each is given to the tokenizer once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "token", 1 << 16):
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(_lengths(definition, some.column("token").to_pylist()), pa.int64())], names=["token", "n", "pieces"])

    return run


def _frequencies(definition: str, known):
    """Texts -> a row each: key of the row, id, bytes, pieces of its known pre-tokens, its other pre-tokens and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, pieces = counter_of(definition), known.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                sums, tokens, counts, ends = [], [], [], [0]
                for text in part.column("text"):
                    found, total = count(text.as_py() or "")
                    for t, n in found.items():
                        p = pieces.get(t)
                        if p is None:
                            tokens.append(t)
                            counts.append(n)
                        else:
                            total += p * n
                    sums.append(total)
                    ends.append(len(tokens))
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                keys = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                at = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(tokens, pa.string())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([keys, part.column("id"), size, pa.array(sums, pa.int64()), *lists], names=["row", "id", "n_bytes", "known", "tokens", "counts"])

    return run


def dictionary_of(texts: DataFrame, definition: str, known, most_held: int = 100_000) -> DataFrame:
    """(token, n, pieces), written: every distinct pre-token of (text) that is not known, its occurrences and its number of pieces."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given by number: pieces are work, however few bytes the vocabulary has
    found = texts.select("text").mapInArrow(_vocabulary(definition, known, most_held), "token string, n long")
    counted = found.repartition(parts, "token").groupBy("token").agg(F.sum("n").alias("n"))  # a task adds a row for a table of it, so none is hot
    return written(counted.mapInArrow(_pieces(definition), "token string, n long, pieces long"))


def is_frequent(total: int, hot_bytes: int):
    """Whether a pre-token's share of `total` occurrences is at least its size over `hot_bytes`."""
    return (F.octet_length("token") + ENTRY) * F.lit(float(total)) <= F.col("n") * F.lit(float(hot_bytes))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", hot_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    The tokenizer file is read once, on the driver.  `hot_bytes` bounds the
    size of the frequent pre-tokens that are sent to every task.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    context = docs.sparkSession.sparkContext
    named = named_pieces(definition)
    slim = over_cores(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    dictionary = dictionary_of(slim, definition, context.broadcast(named))
    frequent = is_frequent(dictionary.agg(F.sum("n")).first()[0] or 0, hot_bytes)
    hot = {r["token"]: r["pieces"] for r in dictionary.filter(frequent).select("token", "pieces").toLocalIterator()}

    kind = slim.schema["id"].dataType.simpleString()
    met = written(slim.mapInArrow(_frequencies(definition, context.broadcast(named | hot)), f"row long, id {kind}, n_bytes long, known long, tokens array<string>, counts array<long>"))
    cold = met.select("row", F.explode(F.arrays_zip("tokens", "counts")).alias("c")).select("row", F.col("c.tokens").alias("token"), F.col("c.counts").alias("count"))
    joined = cold.join(dictionary.filter(~frequent).select("token", "pieces").hint("merge"), "token")  # both grow with the corpus
    sums = joined.groupBy("row").agg(F.sum(F.col("count") * F.col("pieces")).alias("other"))
    tokens = (F.col("known") + F.coalesce("other", F.lit(0))).cast("long")
    out = met.select("row", "id", "n_bytes", "known").join(sums.hint("merge"), "row", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
