"""Personal data, and the terms that give it away.

Four patterns find protected entities. What a term in the text of an entity tells about it is estimated
from the whole corpus: with N documents, IC(e) = log2(N / df(e)) bits are hidden, and a term t
that stands with e in df(e, t) of the df(t) documents that hold it leaves
-log2(df(e, t) / df(t)) of them, that is, it discloses IC(e) less that rest. A term whose rest
is at most ``REMOVE_BITS`` is removed from the entity's text, one up to ``GENERALISE_BITS`` is replaced by
its kind. An estimate needs ``LEAST_CONTEXTS`` different surroundings, so that copies of one
passage prove nothing.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiergrid.hot_keys import join_dealt, join_split
from dossiergrid.llm.batches import bound_batches
from dossiergrid.scratch import materialize, spread

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that may give it away, and code points within which they stand: all of the text's.
WINDOW = REACH = sys.maxsize
#: Different surroundings in which a term must have stood near an entity.
LEAST_CONTEXTS = 3
#: Bits of an entity that a term leaves hidden: up to the first it is removed, up to the second generalised.
REMOVE_BITS, GENERALISE_BITS = 1.0, 2.0
#: Candidate terms are sent to all tasks up to this number; beyond it every word is counted.
MOST_TERMS = 200_000
#: Words a task counts before it passes the counts on.
COUNTED = 200_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number is never entered in its middle: what fails at its first digit fails at the others.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` with a domain behind it, the longest local part before it, behind the last match."""
    end = 0
    for found in _DOMAIN.finditer(text):
        at = found.start()
        before = text[max(end, text.rfind("@", end, at) + 1) : at]
        local = len(before) - len(before.rstrip(_LOCAL))
        if local:
            end = found.end()
            yield at - local, end


def _small(part: str) -> bool:
    """Whether digits are a number up to 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind as its place in ``KINDS``, start, end) in code points, by kind and start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def entity(kind: int, value: str) -> bytes:
    """What two spellings of an entity have in common: letters without case, digits without separators."""
    plain = value.lower() if kind < 2 else _digits(value)
    return hashlib.md5(f"{KINDS[kind]}:{plain}".encode()).digest()


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of all words of the text that no span touches."""
    out = []
    covered: list[list[int]] = []  # the spans' union, as far as it doesn't touch
    for a, b in sorted((a, b) for _, a, b in spans):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    at = 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at == len(covered) or end <= covered[at][0]:
            out.append((m[0].lower(), start, end))
    return out


_WORDS = "array<struct<term:string,start:int,end:int>>"
_WORDS_TYPE = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, text): rows that agree in the first two are alike."""
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    return docs.select(docs[id_col].alias("doc_id"), key.alias("h"), text.cast("binary").alias("text"))


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row its base spans; of a text with any, its entities and all its other words too. Texts are read once and not passed on.

    ``context`` is a hash of those words.
    """
    rows = _keyed(docs, id_col, text_col)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base, who, context, offsets = [], [], [], [0]
            terms, starts, ends = [], [], []
            for value in batch.column(2):
                text = value.as_py().decode("utf-8", "replace")
                spans = base_spans(text)
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[0] == k for s in spans))
                base.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans))
                who.append(list({entity(k, text[a:b]): None for k, a, b in spans}))
                words = free_words(text, spans) if spans else []
                named = " ".join(w[0] for w in words).encode("utf-8", "replace")
                context.append(int.from_bytes(hashlib.blake2b(named, digest_size=8).digest(), "big", signed=True))
                for column, values in zip((terms, starts, ends), zip(*words, strict=True)):
                    column.extend(values)
                offsets.append(len(terms))
            numbers = [pa.array(c, pa.int64()) for c in counts]
            each = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(_WORDS_TYPE.value_type))
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)
            columns = [batch.column(0), batch.column(1), *numbers, pa.array(base), pa.array(who, pa.list_(pa.binary())), pa.array(context, pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", *(f"n_{k}" for k in KINDS), "base", "who", "context", "words"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, h {kinds['h']}, {counts}, base string, who array<binary>, context long, words {_WORDS}")


def _document_counts(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, df): the rows that hold each of the ``terms``.

    Few terms go to all tasks, which then count no other word; beyond ``MOST_TERMS`` all words are
    counted. Tasks pass on partial counts, so a word that every text holds costs a row a task.
    """
    spark = docs.sparkSession
    few = terms.count() <= MOST_TERMS
    wanted = spark.sparkContext.broadcast(frozenset(r["term"] for r in terms.toLocalIterator())) if few else None
    most = COUNTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                words = set(_WORD.findall(value.as_py().decode("utf-8", "replace").lower()))
                count.update(words & wanted.value if wanted is not None else words)
                if len(count) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], ["term", "df"])
                    count.clear()
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], ["term", "df"])

    texts = docs.select(F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return counted if few else counted.join(terms, "term", "left_semi")


def _texts(found: DataFrame) -> DataFrame:
    """(h, rows, context, who, words): every different text with an entity once."""
    some = found.where(F.size("who") > 0)
    return some.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), *[F.any_value(c).alias(c) for c in ("context", "who", "words")])


def disclosing_terms(docs: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, term, removed): of every text the terms that leave at most ``GENERALISE_BITS`` of one of its entities hidden.

    ``texts``: what ``_texts`` gives for ``docs``. A term is ``removed`` if it leaves at most ``REMOVE_BITS``. Entities of fewer
    surroundings than an estimate needs, and terms that most rows hold without such an entity, are ruled out by
    counts of their own before entities and terms are paired; what they rule out can't pass.
    """
    rest = lambda part, whole: -F.log2(F.col(part) / F.col(whole))
    named = texts.select("h", "rows", "context", F.explode("who").alias("entity"))
    # Partial sums first: an entity or a passage that very many rows hold costs a row a task.
    known = named.groupBy("entity", "context").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n"))
    known = known.groupBy("entity").agg(F.sum("rows").alias("seen"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"))
    known = materialize(known.where(F.col("contexts") >= LEAST_CONTEXTS).drop("contexts"), "pii-entities")
    named = materialize(join_split(named, known, ["entity"], named.count()), "pii-named")
    held = texts.join(named.select("h").distinct(), "h", "left_semi").select("h", "rows", F.explode(F.array_distinct("words.term")).alias("term"))
    held = materialize(held, "pii-held")
    best = held.groupBy("term").agg(F.sum("rows").alias("best"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_CONTEXTS)
    best = materialize(best, "pii-terms")
    counted = _document_counts(docs, best.select("term"), id_col, text_col)
    telling = materialize(best.join(counted, "term").where(rest("best", "df") <= GENERALISE_BITS).select("term", "df", "n"), "pii-telling")
    told = join_split(held.select("h", "term"), telling, ["term"], held.count())
    pairs = join_dealt(told, named, ["h"], F.col("term"), held.count()).where(rest("seen", "df") <= GENERALISE_BITS)
    pairs = materialize(pairs.select("h", "rows", "context", "entity", "term", "df"), "pii-pairs")
    per_context = pairs.groupBy("entity", "term", "context").agg(F.sum("rows").alias("rows"), F.any_value("df").alias("df"), F.count(F.lit(1)).alias("n"))
    together = per_context.groupBy("entity", "term").agg(F.sum("rows").alias("together"), F.any_value("df").alias("df"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"))
    rules = together.where(F.col("contexts") >= LEAST_CONTEXTS).where(rest("together", "df") <= GENERALISE_BITS)
    rules = materialize(rules.select("entity", "term", (rest("together", "df") <= REMOVE_BITS).alias("removed"), "n"), "pii-rules")
    hits = join_split(pairs.select("h", "entity", "term"), rules, ["entity", "term"], pairs.count())
    return hits.groupBy("h", "term").agg(F.max("removed").alias("removed"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``h``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base``, ``terms`` of every row.

    ``base`` lists the entities as kind:start:end, joined by commas; ``terms`` has (start, end, removed) of the
    words of the text that give them away, by start. Offsets are code points. Null texts are empty and have
    neither. Repeated rows are alike (and count as often as they occur); identifiers may repeat or be null. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    found = materialize(_found(docs, id_col, text_col), "pii-found")
    texts = materialize(_texts(found), "pii-texts")
    hits = disclosing_terms(docs, texts, id_col, text_col)
    spans = texts.select("h", F.inline("words")).join(hits, ["h", "term"])
    spans = spans.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "removed"))).alias("terms"))
    every = texts.select("h", F.col("rows").alias("n")).join(spans, "h", "left")
    some, rows = F.size("who") > 0, found.drop("words", "context")
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    met = join_split(rows.where(some), every, ["h"], rows.where(some).count())
    out = met.unionByName(rows.where(~some).withColumn("terms", F.lit(None).cast("array<struct<start:int,end:int,removed:boolean>>")))
    return out.select("doc_id", "h", *[f"n_{k}" for k in KINDS], "base", F.coalesce("terms", none).alias("terms"))


def all_spans(base: Column, terms: Column) -> Column:
    """Base spans and terms as one list, the terms behind the base ones."""
    added = F.array_join(F.transform(terms, lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string"))), ",")
    return F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(added, F.lit("")))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` of every row, without what ``find_personal_data`` finds.

    An entity becomes its kind in brackets. A term that gives it away is removed (``[REMOVED]``) or
    generalised to ``[NUMBER]``, ``[NAME]`` (if it begins with a capital) or ``[TERM]``. Of spans that overlap the first, and of those
    the longest, counts. Null texts stay null.
    """
    found = find_personal_data(docs, id_col, text_col)
    some = found.where((F.col("base") != "") | (F.size("terms") > 0)).select(F.col("doc_id").alias("of_doc"), F.col("h").alias("of_h"), "base", "terms").dropDuplicates(["of_doc", "of_h"])
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    rows = _keyed(kept.where("text is not null"), "doc_id", "text").join(some, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("h") == F.col("of_h")), "left")
    rows = rows.select("doc_id", "text", "base", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, base, terms in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                out.append(_rewritten(text.decode("utf-8", "replace"), base, terms) if base is not None else text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rewritten = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
    return rewritten.unionByName(kept.where("text is null"))


def _rewritten(text: str, base: str, terms: list[dict]) -> str:
    places = []
    for span in base.split(",") if base else ():
        kind, a, b = span.split(":")
        places.append((int(a), -int(b), f"[{kind.upper()}]"))
    for t in terms:
        word = text[t["start"] : t["end"]]
        places.append((t["start"], -t["end"], "[REMOVED]" if t["removed"] else "[NUMBER]" if word.isdigit() else "[NAME]" if word[0].isupper() else "[TERM]"))
    out, at = [], 0
    for a, b, said in sorted(places):
        if a >= at:
            out += [text[at:a], said]
            at = -b
    return "".join([*out, text[at:]])


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), all_spans(F.col("base"), F.col("terms")).alias("spans"))
