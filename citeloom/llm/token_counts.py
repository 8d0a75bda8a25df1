"""Token counts as delta-maintained rollups.

Documents are counted once, by tokenizers whose files are parameters. Changes come in batches of signed rows: an
insert adds a document's counts, a delete takes them back, and a revised count does both. A batch is summed by source,
language and tokenizer version before anything is stored, and its sums are committed under the batch's name, so
totals are the sum of the committed batches and never need the documents again. A commit writes to a folder of its
own and then moves it to the batch's name in one step: a batch delivered twice, or repeated after a lost driver,
counts once, and of two writers of one batch one is told that it was late. That rests on a rename that is one step, as
in HDFS and local folders; a store of objects has none and needs a folder with that promise for its commits.
Compaction folds all batches into one, whose name list keeps them from being applied again.

Defined cases: a null or empty text has no tokens, but its document counts; a very long text is counted piece by piece; a
null source or language is a group of its own; ids are passed on as they are, null or not; repeated rows count each time;
an empty table or batch commits without rows; groups whose documents are all deleted keep a row of zeros until
compaction drops it; other columns, clashing names among them, are never read.
"""

from __future__ import annotations

import base64
import importlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick

#: Words as the simplest tokenizer counts them.
WORDS = r"[^\x20\x09-\x0D]+"
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "chars"]


def encoding(vocabulary: bytes, pattern: str):
    """A byte-level tokenizer of the lines (token in base 64, rank) of a vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> tuple[str, str]:
    """(path, split pattern) of the byte-level vocabulary in the module public_tokenizers, which the machine offers."""
    public = importlib.import_module("public_tokenizers")
    return str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN


def tokens_of(encoding, pattern: regex.Pattern, text: str | None, whole: int = 200_000) -> int:
    """The number of tokens of a text. A text longer than whole is counted by the pieces that the pattern splits it into,
    equal pieces once, which is what the tokenizer does to a whole text without holding its tokens."""
    if not text:
        return 0
    if len(text) <= whole:
        return len(encoding.encode_ordinary(text))
    pieces: Counter[str] = Counter()
    n = 0
    for m in pattern.finditer(text):
        pieces[m[0]] += 1
        if len(pieces) > 100_000:
            n += sum(k * len(encoding._encode_single_piece(piece)) for piece, k in pieces.items())
            pieces.clear()
    return n + sum(k * len(encoding._encode_single_piece(piece)) for piece, k in pieces.items())


def _tokens(vocabulary, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = encoding(vocabulary.value, pattern), regex.compile(pattern)
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.slice(i, 1000)
                counts = [tokens_of(own, split, text) for text in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64()), *part.columns[1:]], names=["tokens", *batch.schema.names[1:]])

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(tokens, id, source, lang, chars, words) of every document; path: the vocabulary file, which the driver reads and sends to all tasks."""
    with open(path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # a file of a fixed size
    narrow = pick(docs, text=text_col, id=id_col, source=source_col, lang=lang_col)
    length = F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars")
    words = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("words")
    narrow = narrow.select("text", "id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), length, words)
    schema = f"tokens bigint, id {narrow.schema['id'].dataType.simpleString()}, source string, lang string, chars bigint, words bigint"
    return narrow.mapInArrow(_tokens(vocabulary, pattern), schema)


def change(rows: DataFrame, sign: int, tokenizer: str, tokens: str | Column) -> DataFrame:
    """Signed rows of one tokenizer version; tokens: the column with its counts."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("bigint").alias("docs"), (tokens * sign).alias("tokens"), (F.col("chars") * sign).alias("chars"))


class Rollup:
    """Totals under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        """The folders that count: the newest compacted table and the batches that it does not hold."""
        at = self._paths(self.path)
        names = sorted(str(x.getPath().getName()) for x in self._fs.listStatus(at)) if self._fs.exists(at) else []
        tables = sorted((n for n in names if n.startswith("compact=")), key=lambda n: int(n[8:]))[-1:]
        held = {f"batch={b}" for t in tables for b in self._applied(t)}
        return tables + [n for n in names if n.startswith("batch=") and n not in held]

    def _applied(self, table: str) -> set[str]:
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{table}/applied").collect()}

    def committed(self) -> set[str]:
        """The batches that count, compacted ones among them."""
        out = set()
        for name in self._names():
            if name.startswith("batch="):
                out.add(name[6:])
            else:
                out |= self._applied(name)
        return out

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch once; False, and nothing done, if it counts already."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"batch name {batch!r}")
        if batch in self.committed():
            return False
        hidden = f"{self.path}/.{uuid.uuid4().hex}"
        sums = changes.groupBy(*KEYS).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in SUMS))
        sums.coalesce(1).write.parquet(hidden)
        return self._move(hidden, f"{self.path}/batch={batch}")

    def _move(self, hidden: str, place: str) -> bool:
        """Moves a folder to its place in one step; False if another writer was first."""
        place = self._paths(place)
        moved = not self._fs.exists(place) and self._fs.rename(self._paths(hidden), place)
        # where the place came into being in between, a rename moves the folder into it
        inside = self._paths(place, hidden.rpartition("/")[2])
        if moved and self._fs.exists(inside):
            self._fs.delete(inside, True)
            moved = False
        if not moved:
            self._fs.delete(self._paths(hidden), True)
        return moved

    def totals(self) -> DataFrame:
        parts = [f"{self.path}/{n}" + ("" if n.startswith("batch=") else "/totals") for n in self._names()]
        schema = ", ".join([*(f"{k} string" for k in KEYS), *(f"{s} bigint" for s in SUMS)])
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*parts)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))

    def compact(self) -> None:
        """Folds all batches into one table; readers see the old batches until the new table is in place."""
        old, batches = self._names(), sorted(self.committed())
        hidden = f"{self.path}/.{uuid.uuid4().hex}"
        self.totals().where("docs <> 0 or tokens <> 0 or chars <> 0").coalesce(1).write.parquet(f"{hidden}/totals")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.parquet(f"{hidden}/applied")
        # the name lists what the table replaces: after a crash between these steps the old folders no longer count
        generation = 1 + max([0, *(int(n[8:]) for n in old if n.startswith("compact="))])
        if not self._move(hidden, f"{self.path}/compact={generation}"):
            return
        for name in old:
            self._fs.delete(self._paths(f"{self.path}/{name}"), True)
