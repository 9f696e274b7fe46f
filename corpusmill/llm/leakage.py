"""Held-out test passages inside a training corpus: a generalised suffix automaton over test words."""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.neardups import shingle
from corpusmill.shared import cut, partitions_of

_WORD = re.compile(r"[^\W_]+")

#: about so many test words share one automaton; more test items make more automata, built where they are used
AUTOMATON_WORDS = 400_000
#: documents that one task scans with one automaton
TASK_DOCS = 5_000
#: bits of the filter of test runs that the corpus passes; its size (16 MB) never grows
FILTER_BITS = 1 << 27


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits after NFC and lower-casing."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


def placed_words(text: str) -> tuple[str, list[tuple[int, int]]]:
    """(the text after NFC, where in it each of :func:`words` stands)."""
    nfc = text if text.isascii() else unicodedata.normalize("NFC", text)
    low = nfc.lower()
    if len(low) == len(nfc):
        return nfc, [m.span() for m in _WORD.finditer(low)]
    # a few letters grow when lower-cased: every place of the lower-cased text is taken back to its letter
    back = [i for i, c in enumerate(nfc) for _ in c.lower()]
    back += [len(nfc)] * (len(low) + 1 - len(back))
    return nfc, [(back[m.start()], back[m.end() - 1] + 1) for m in _WORD.finditer(low)]


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items every state of ``min_run`` words belongs to."""

    def __init__(self, items: Iterable[tuple[int, Sequence[str]]], min_run: int):
        self.min_run = min_run
        self.vocab: dict[str, int] = {}
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        ends: dict[int, set[int]] = {}

        def state(n: int, edges: dict[int, int], suffix: int) -> int:
            nxt.append(edges)
            link.append(suffix)
            length.append(n)
            return len(nxt) - 1

        def split(p: int, w: int, q: int) -> int:
            """The state for the shorter words of q that end p's words extended by w."""
            clone = state(length[p] + 1, dict(nxt[q]), link[q])
            link[q] = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            return clone

        for item, seq in items:
            last = 0
            for word in seq:
                w = self.vocab.setdefault(word, len(self.vocab))
                q = nxt[last].get(w)
                if q is not None:
                    last = q if length[q] == length[last] + 1 else split(last, w, q)
                else:
                    cur = state(length[last] + 1, {}, 0)
                    p = last
                    while p >= 0 and w not in nxt[p]:
                        nxt[p][w] = cur
                        p = link[p]
                    if p >= 0:
                        q = nxt[p][w]
                        link[cur] = q if length[q] == length[p] + 1 else split(p, w, q)
                    last = cur
                ends.setdefault(last, set()).add(item)
        # an item of a state's words has their suffixes too; states below min_run hold none
        own = {s: i for s, i in ends.items() if length[s] >= min_run}
        for s in sorted((s for s in range(1, len(nxt)) if length[s] >= min_run), key=length.__getitem__, reverse=True):
            if s in own and length[link[s]] >= min_run:
                own[link[s]] = own.get(link[s], set()) | own[s]
        self.next, self.link, self.length = nxt, array("i", link), array("i", length)
        self.items = {s: tuple(sorted(i)) for s, i in own.items()}

    def scan(self, tokens: Sequence[str]) -> dict[int, tuple[list[tuple[int, int]], int]]:
        """Per item, (the spans [first, end) of the tokens, merged, that stand in it as runs of min_run or more; words of the longest such run)."""
        nxt, link, length, items, least = self.next, self.link, self.length, self.items, self.min_run
        spans: dict[int, list[tuple[int, int]]] = {}
        longest: dict[int, int] = {}
        s = n = 0
        for end, w in enumerate(map(self.vocab.get, tokens), 1):
            if w is None:
                s = n = 0
                continue
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            s = nxt[s].get(w, 0)
            n = n + 1 if s else 0
            if n < least:
                continue
            # from the longest match to shorter suffixes: each brings the items that no longer one has
            seen: set[int] = set()
            at, size = s, n
            while size >= least:
                for item in items.get(at, ()):
                    if item in seen:
                        continue
                    seen.add(item)
                    longest[item] = max(longest.get(item, 0), size)
                    mine = spans.setdefault(item, [])
                    if mine and end - size <= mine[-1][1]:
                        mine[-1] = (mine[-1][0], end)
                    else:
                        mine.append((end - size, end))
                at = link[at]
                size = length[at]
        return {item: (x, longest[item]) for item, x in spans.items()}


def _run_hashes(texts: list[str | None], min_run: int) -> tuple[np.ndarray, np.ndarray]:
    row, h, _ = shingle(texts, min_run)
    return row, h.view(np.int64)


def _item_runs(items: DataFrame, min_run: int, shards: int) -> DataFrame:
    """run (hash of min_run words), shard of every run of the test items, computed where the items are."""

    def runs(batches):
        for b in batches:
            row, h = _run_hashes(b.column(1).to_pylist(), min_run)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(0).take(pa.array(row))], names=["run", "shard"])

    return items.select("_shard", "_text").mapInArrow(runs, "run long, shard int").distinct()


def _filter_bits(runs: DataFrame) -> np.ndarray:
    """Bitmap of FILTER_BITS hashed runs, built in the cluster piece by piece."""
    piece = 1 << 17

    def bits(t: pa.Table) -> pa.Table:
        b = np.zeros(piece, np.uint8)
        b[t.column("bit").to_numpy() % piece] = 1
        return pa.table({"piece": t.column("piece").slice(0, 1), "bits": pa.array([np.packbits(b).tobytes()], pa.binary())})

    at = runs.select(F.pmod("run", F.lit(FILTER_BITS)).alias("bit")).distinct().withColumn("piece", F.floor(F.col("bit") / piece))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in at.groupBy("piece").applyInArrow(bits, "piece long, bits binary").toLocalIterator():
        out[r["piece"] * (piece // 8) : (r["piece"] + 1) * (piece // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


LEAK = "item_id long, spans array<struct<first: int, end: int>>, longest int, covered int, n_words int"


def find_leaks(docs: DataFrame, items: DataFrame, min_run: int = 12, key: str = "doc_id", text: str = "text", item_key: str = "item_id", keep_text: bool = False) -> DataFrame:
    """Documents that share a run of at least ``min_run`` words with a test item.

    Returns doc key, _row (a number of the document's row, so that repeated keys stay apart), item_id, spans (places of the
    leaked words, counted in words, merged), longest (words of the longest single run that both share), covered (words inside spans) and
    n_words; with ``keep_text`` the text too.

    The corpus is read once: documents that hold no run of the test items by a bitmap of fixed size are put aside, the others are kept with
    the hashes of their runs, and each meets the automata of the items that have one of them.  An automaton holds about AUTOMATON_WORDS
    words and is built in the task that scans with it; documents of one automaton are split into tasks of TASK_DOCS.  NULL and empty texts
    give no rows; repeated items and documents are reported each; a document of any length is one pass over its words.  Other columns are
    ignored.  No items: no rows.
    """
    n_words = F.size(F.split(F.col(text), r"\s+"))
    total = items.agg(F.sum(F.when(F.length(text) > 0, n_words))).first()[0] or 0
    shards = max(1, -(-int(total) // AUTOMATON_WORDS))
    cast = items.select(F.col(item_key).cast("long").alias("_item"), F.col(text).alias("_text")).filter("_item is not null and _text != ''")
    cast = cast.withColumn("_shard", F.pmod(F.xxhash64("_item"), F.lit(shards)).cast("int"))
    runs = cut(_item_runs(cast, min_run, shards), "runs")
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(runs))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                row, h = _run_hashes(part.column(1).to_pylist(), min_run)
                bit = h & (FILTER_BITS - 1)
                hit = (bits[bit >> 3] >> (7 - (bit & 7)) & 1).astype(bool)
                row, h = row[hit], h[hit]
                at, first = np.unique(row, return_index=True)
                if not len(at):
                    continue
                ends = np.r_[first[1:], len(row)]
                found = pa.array([np.unique(h[i:j]) for i, j in zip(first, ends)], pa.list_(pa.int64()))
                p = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([p.column(0).cast(pa.int64()), p.column(1), found], names=["_doc", "_text", "_runs"])

    sifted = docs.select(key, text).mapInArrow(sift, "_doc long, _text string, _runs array<long>")
    sifted = cut(sifted.withColumn("_row", F.monotonically_increasing_id()), "sifted")
    hits = sifted.select("_row", F.explode("_runs").alias("run")).join(runs, "run").select("_row", "shard").distinct()
    hits = cut(hits, "hits")
    sizes = hits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / TASK_DOCS).cast("int").alias("_k"))
    sizes = sizes.select("shard", F.greatest("_k", F.least(F.lit(partitions_of(docs.sparkSession)), F.col("_k") * 8)).alias("_k"))
    work = hits.join(sizes, "shard").withColumn("_block", F.pmod(F.xxhash64("_row"), F.col("_k")).cast("int"))
    work = work.join(sifted.select("_row", "_doc", "_text"), "_row").select("shard", "_block", "_row", "_doc", "_text")
    # the items of a shard go to each of its blocks
    tools = cast.withColumnRenamed("_shard", "shard").join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_block"), "_item", "_text")
    names = [key, "_row", *(["text"] if keep_text else []), *[x.split()[0].rstrip(":") for x in LEAK.replace("array<struct<first: int, end: int>>", "x").split(", ")]]
    schema = f"{key} long, _row long, {'text string, ' if keep_text else ''}{LEAK}"
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64(), pa.int64(), *([pa.string()] if keep_text else []), pa.int64(), span, pa.int32(), pa.int32(), pa.int32()]

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            order = sorted(zip(right.column("_item").to_pylist(), right.column("_text").to_pylist()))
            a = SuffixAutomaton([(i, words(t)) for i, t in order], min_run)
            for row, doc, t in zip(left.column("_row").to_pylist(), left.column("_doc").to_pylist(), left.column("_text").to_pylist()):
                tokens = words(t)
                for item, (spans, longest) in a.scan(tokens).items():
                    rows.append((doc, row, *([t] if keep_text else []), item, [{"first": x, "end": y} for x, y in spans], longest, sum(y - x for x, y in spans), len(tokens)))
        cols = list(zip(*rows)) if rows else [[]] * len(types)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return work.groupBy("shard", "_block").cogroup(tools.groupBy("shard", "_block")).applyInArrow(scan, schema)


def clean_leaks(leaks: DataFrame, key: str = "doc_id", max_run: int = 30, max_coverage: float = 0.5) -> DataFrame:
    """One row per leaking document: its verdict and the text without the leaked passages.

    ``leaks`` as of :func:`find_leaks` with ``keep_text``.  Returns key, n_items, longest, coverage (share of the document's words inside
    spans of any item), verdict and cleaned.  ``drop``: the longest run exceeds max_run words or the coverage exceeds max_coverage, and
    cleaned is NULL; else ``cut spans``: cleaned is the text after NFC without the characters from each span's first to its last word, and
    with one of two spaces left where both sides had one.  The leaks of one document are brought together by its row; they are at most its items.
    """

    def settle(t: pa.Table) -> pa.Table:
        spans = sorted((s["first"], s["end"]) for x in t.column("spans").to_pylist() for s in x)
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        longest, n = max(t.column("longest").to_pylist()), t.column("n_words")[0].as_py()
        coverage = sum(b - a for a, b in merged) / n
        cleaned = None
        if longest <= max_run and coverage <= max_coverage:
            text, at = placed_words(t.column("text")[0].as_py())
            out, last = [], 0
            for a, b in merged:
                left = text[last : at[a][0]]
                out.append(left)
                last = at[b - 1][1]
                if left[-1:].isspace() and text[last : last + 1].isspace():
                    last += 1
            cleaned = "".join([*out, text[last:]])
        return pa.table({
            key: t.column(key).slice(0, 1), "n_items": pa.array([len(set(t.column("item_id").to_pylist()))], pa.int64()), "longest": pa.array([longest], pa.int32()),
            "coverage": pa.array([coverage], pa.float64()), "verdict": pa.array(["cut spans" if cleaned is not None else "drop"]), "cleaned": pa.array([cleaned], pa.string()),
        })

    return leaks.groupBy("_row").applyInArrow(settle, f"{key} long, n_items long, longest int, coverage double, verdict string, cleaned string")


def leak_report(leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Test items that leaked: item_id, n_docs, longest run, words covered in all documents together."""
    return leaks.groupBy("item_id").agg(F.count_distinct("_row").alias("n_docs"), F.max("longest").alias("longest"), F.sum("covered").alias("covered"))
