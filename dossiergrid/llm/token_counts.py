"""Token counts with a whole-token shortcut.

A byte-pair model whose pieces never hold a space mark behind another character,
nor a line feed beside another one, can merge nothing across those places. A
text then falls into pre-tokens that are encoded independently. Offline, every
vocabulary string is encoded alone; those that give exactly one token are the
whole tokens. In the texts, pre-tokens found among them count one without any
merging, and only the others go through the library's merges (remembered in a
bounded table, since most words recur). Where the model doesn't have these
properties, every text is encoded whole by the library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.scratch import spread

MARK = "▁"
#: Entries of a worker's table of merged pre-tokens; it is emptied when full.
REMEMBERED = 1 << 18


@dataclass(frozen=True)
class Proof:
    """What was shown offline about a model."""

    splits: bool
    whole: frozenset[str]


def prove(model: bytes) -> Proof:
    """Check the model's pieces and encode each vocabulary string alone."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    plain = [i for i in range(len(pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    splits = all(MARK not in pieces[i].lstrip(MARK) and "\n" not in pieces[i] for i in plain)
    return Proof(splits and spaces_only(model), frozenset(pieces[i][1:] for i in plain if pieces[i][:1] == MARK and sp.encode(pieces[i][1:]) == [i] and len(pieces[i]) > 1))


def spaces_only(model: bytes) -> bool:
    """Whether the model merges byte pairs and its normaliser, as the file specifies it, only turns
    spaces into marks and puts one mark in front: no character map, no rules, spaces kept."""
    spec: dict[str, dict[int, int | bytes]] = {"trainer": {}, "normalizer": {}}
    for number, value in _fields(model):
        if number in (2, 3):
            spec["trainer" if number == 2 else "normalizer"].update(_fields(value))
    trainer, normalizer = spec["trainer"], spec["normalizer"]
    # Defaults of the published format where a field is left out.
    return (
        trainer.get(3, 1) == 2 and not trainer.get(24, 0)
        and not normalizer.get(2, b"") and not normalizer.get(6, b"")
        and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
    )


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer; fixed-width values as their bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


class Counter:
    """Counts the tokens of texts as the library gives them."""

    def __init__(self, model: bytes, proof: Proof):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.splits = proof.splits
        self.whole = dict.fromkeys(proof.whole, 1)
        encode, whole = self.sp.encode, self.whole

        class Merged(dict):
            """Pre-token (without its space mark) to tokens."""

            def __missing__(self, word: str) -> int:
                if len(self) >= REMEMBERED:
                    self.clear()
                    self.update(whole)
                # A pre-token behind a line feed has no mark in front: take off the one the library adds.
                n = len(encode(word)) - (word[0] == "\n")
                if len(word) <= 64:
                    self[word] = n
                return n

        self.merged = Merged(whole)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.sp.encode(text))
        marked = text.replace(MARK, " ").replace("\n", " \n")
        words = marked.split(" ")
        of = self.merged.__getitem__
        if "  " not in marked and marked[0] != " " and marked[-1] != " ":
            return sum(map(of, words))
        total = run = 0
        for word in words:
            if not word:
                run += 1
            elif word[0] == "\n":
                total += (self._marks(run) if run else 0) + of(word)
                run = 0
            else:
                # the library puts one mark in front by itself
                total += len(self.sp.encode(" " * run + word)) if run else of(word)
                run = 0
        return total + (self._marks(run) if run else 0)

    def _marks(self, n: int) -> int:
        """Tokens of a run of ``n`` space marks."""
        return len(self.sp.encode(" " * (n - 1))) if n > 1 else 1


#: By the SHA-256 of the model, so that a reused worker never counts with another one.
_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row.

    ``model`` is the content of a sentencepiece model file; it is sent to the
    executors, which need no file of their own. Null texts are empty and have no
    token. Invalid UTF-8 is counted with replacement characters. Rows are
    independent: repeated rows, null identifiers and other columns are no matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), model, prove(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sent, proof = shared.value
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(sent, proof)
        counter = _counters[key]
        for batch in batches:
            n = [counter.count(t.as_py().decode("utf-8", "replace")) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.select(docs[id_col].alias("doc_id")).dtypes[0][1]
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"),
        docs[text_col].cast("binary").alias("text"),
    )
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return token_counts(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), model)
