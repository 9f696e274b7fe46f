"""Texts decoded with the wrong character encoding: finding the garbled runs and restoring them."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: characters from here on are counted by block of 256, so the statistics have a bounded alphabet
SINGLE = 0x3000
BLOCKS = SINGLE + (0x110000 >> 8)
REACH = 12
_LOST = "�"
_RUN = re.compile(r"[^\x00-\x7f]+")


def _table(codec: str) -> dict[int, str]:
    """Character of every byte; bytes that the codec leaves open keep the control character of the same number."""
    return {b: bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)}


def _utf8_as(codec: str) -> dict[str, int]:
    return {c: b for b, c in _table(codec).items() if b >= 0x80}


def _single_as(written: str, read: str) -> dict[str, str]:
    """What a character was before text written in one 8-bit encoding was read in another."""
    w, r = _table(written), _table(read)
    return {r[b]: w[b] for b in range(0x80, 256) if r[b] != w[b] and w[b].isprintable() and not r[b].isspace() and r[b] not in _LOST}


#: 8-bit encodings that UTF-8 is commonly read as
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "mac_roman", "iso8859_2", "iso8859_15")
#: (written, read) pairs of 8-bit encodings
SINGLE_READ_AS = (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("iso8859_2", "cp1252"), ("cp1252", "cp1251"))


def char_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of adjacent characters over all documents: a, b, n (-1 stands for the edges of a text)."""

    def count(batches):
        total: dict[int, int] = {}
        for b in batches:
            got = [t for t in b.column(0).to_pylist() if t]
            for i in range(0, len(got), 2000):
                cp = np.frombuffer(("\n".join(got[i : i + 2000])).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                cp = np.where(cp < SINGLE, cp, SINGLE + (cp >> 8))
                k = cp[:-1] * BLOCKS + cp[1:]
                low = (cp[:-1] < 128) & (cp[1:] < 128)  # most pairs: counted without sorting
                n = np.bincount(cp[:-1][low] * 128 + cp[1:][low], minlength=128 * 128)
                for j in np.flatnonzero(n):
                    key = int(j // 128) * BLOCKS + int(j % 128)
                    total[key] = total.get(key, 0) + int(n[j])
                u, c = np.unique(k[~low], return_counts=True)
                for key, m in zip(u.tolist(), c.tolist()):
                    total[key] = total.get(key, 0) + m
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k // BLOCKS for k in keys], pa.int32()), pa.array([k % BLOCKS for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())], names=["a", "b", "n"])

    return docs.select(text).mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


@dataclass
class PairModel:
    """Character-pair statistics of a corpus, as pointwise mutual information and as log probability."""

    pair: dict[int, int]
    left: dict[int, int]
    right: dict[int, int]
    total: int

    @classmethod
    def of(cls, rows: pd.DataFrame) -> PairModel:
        pair, left, right = {}, {}, {}
        for a, b, n in zip(rows["a"].tolist(), rows["b"].tolist(), rows["n"].tolist()):
            pair[a * BLOCKS + b] = n
            left[a] = left.get(a, 0) + n
            right[b] = right.get(b, 0) + n
        return cls(pair, left, right, sum(left.values()))

    @staticmethod
    def _of(c: str) -> int:
        o = ord(c)
        return o if o < SINGLE else SINGLE + (o >> 8)

    def info(self, a: str, b: str) -> float:
        """Pointwise mutual information of a pair, in bits, smoothed; the occurrence under test itself doesn't count."""
        x, y = self._of(a), self._of(b)
        n = max(0, self.pair.get(x * BLOCKS + y, 0) - 1)
        return math.log2((n + 0.5) * (self.total + 1) / ((self.left.get(x, 0) + 1) * (self.right.get(y, 0) + 1)))

    def cost(self, s: str) -> float:
        """Bits that a string takes, as a chain of adjacent pairs (its first character is given)."""
        return -sum(self.step(a, b) for a, b in zip(s, s[1:]))

    def step(self, a: str, b: str) -> float:
        """log2 P(b after a), backed off to P(b) for rare contexts; P(b after a) = P(b) * 2^information."""
        x, y = self._of(a), self._of(b)
        base = (self.right.get(y, 0) + 0.1) / (self.total + 1)
        return math.log2((max(0, self.pair.get(x * BLOCKS + y, 0) - 1) + 4 * base) / (self.left.get(x, 0) + 4))


def _cased(table: dict[str, int]) -> dict[str, int]:
    """The table, with lower-case forms of its characters, for garbled text that was lower-cased afterwards."""
    out = dict(table)
    for c, b in table.items():
        if len(low := c.lower()) == 1:
            out.setdefault(low, b)
    lead = {c.lower(): b for c, b in table.items() if 0xC2 <= b <= 0xF4 and c.lower() != c and len(c.lower()) == 1}
    return out | lead


def misplaced(a: str, c: str, b: str) -> bool:
    """Can't a non-ASCII character stand between two neighbours, by its Unicode category and script?"""
    kind = unicodedata.category(c)
    if kind[0] == "L" and kind != "Lm":
        latin = unicodedata.name(c, "").startswith(("LATIN", "FEMININE", "MASCULINE", "MICRO"))
        mixed = not latin and any(x.isalpha() and unicodedata.name(x, "").startswith("LATIN") for x in (a, b))
        return mixed or b.isdigit() or (kind == "Lu" and a.islower())
    inside = a.isalpha() and b.isalpha()
    if kind in ("Sm", "Lm", "Sk") or (kind == "So" and c >= "\u2190"):
        return a.isalpha() or b.isalnum()
    if kind == "Po" and c not in "\u2026\u00bf\u00a1":
        return a.isalpha() or b.isalnum()
    return inside and c != "\u2019"


class Restorer:
    """Finds and undoes wrong decodings inside improbable runs of one text."""

    def __init__(self, model: PairModel, least_gain: float = 1.0, least_swap: float = 8.0):
        self.model = model
        self.least = least_gain
        self.least_swap = least_swap
        self.runs: dict[str, tuple[str, str, bool]] = {}
        self.saved: dict[tuple[str, str], float] = {}
        self.multi = [(f"utf-8 as {c}", _utf8_as(c)) for c in UTF8_READ_AS]
        self.multi += [(f"utf-8 as {c}, lower-cased", _cased(_utf8_as(c))) for c in ("cp1252", "latin-1", "cp1250")]
        self.single = [(f"{w} as {r}", _single_as(w, r)) for w, r in SINGLE_READ_AS]
        self.gain: dict[str, float] = {}

    def segments(self, s: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments of adjacent pairs, scored by how far their information lies below the usual.

        A pair inside non-ASCII characters scores what its probability lacks, since two characters that only ever occur
        garbled together inform about each other; all other pairs score minus their information.
        """
        score = []
        for a, b in zip(s, s[1:]):
            k = a + b
            if (v := self.gain.get(k)) is None:
                if a < "\x80" and b < "\x80":
                    v = -4.0
                elif a >= "\x80" and b >= "\x80":
                    v = -self.model.step(a, b) if a == _LOST or b == _LOST else 6.0 - self.model.info(a, b) / 4
                else:
                    v = 1.5 - self.model.info(a, b)
                self.gain[k] = v
            score.append(v)
        # Ruzzo and Tompa: all maximal segments in one pass
        found: list[list[float]] = []
        run = 0.0
        for i, v in enumerate(score):
            before, run = run, run + v
            if v <= 0:
                continue
            new = [i, i + 1, before, run]
            while True:
                j = len(found) - 1
                while j >= 0 and found[j][2] >= new[2]:
                    j -= 1
                if j < 0 or found[j][3] >= new[3]:
                    break
                new = [found[j][0], new[1], found[j][2], new[3]]
                del found[j:]
            found.append(new)
        return [(int(x[0]), int(x[1]) + 1) for x in found]

    def undo(self, s: str, table: dict[str, int]) -> str:
        """Every valid UTF-8 sequence of mapped characters decoded; all else as it is."""
        out, i, n = [], 0, len(s)
        while i < n:
            b = table.get(s[i])
            if b is not None and 0xC2 <= b <= 0xF4:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                raw = [b, *[table.get(c, 0) for c in s[i + 1 : i + need]]]
                if len(raw) == need and all(0x80 <= x <= 0xBF for x in raw[1:]):
                    try:
                        out.append(bytes(raw).decode())
                        i += need
                        continue
                    except UnicodeDecodeError:
                        pass
            out.append(s[i])
            i += 1
        return "".join(out)

    def known(self, s: str, before: str) -> bool:
        """Every character is one the corpus has elsewhere or had here already."""
        return all(c < "\x80" or c in before or (not "\x80" <= c < "\xa0" and self.model.right.get(self.model._of(c), 0) > 1) for c in s)

    def best(self, s: str) -> tuple[float, str, str]:
        """The inverse mapping, applied up to three times, that saves most bits on a run with its neighbours: (bits, name, restored)."""
        top = (0.0, "", s)
        was = self.model.cost(s)
        for name, table in self.multi:
            new = s
            for times in ("", ", twice", ", three times"):
                last, new = new, self.undo(new, table)
                if new == last:
                    break
                if (bits := was - self.model.cost(new)) > top[0] and self.known(new, s):
                    top = (bits, name + times, new)
        return top

    def repair(self, run: str) -> tuple[str, str, bool]:
        """(restored run, mapping or "", is the run improbable) of a non-ASCII run with one neighbour on each side; kept for repeated runs."""
        if (got := self.runs.get(run)) is None:
            if len(self.runs) > 200_000:  # a memo of repeated runs; without an entry the run is computed again
                self.runs.clear()
            new, name, places = run, "", []
            # a character may have become twelve (three wrong readings of up to four bytes): a segment takes in all it may cut
            for i, j in self.segments(run):
                i, j = max(0, i - REACH), min(len(run), j + REACH)
                if places and i <= places[-1][1]:
                    i = places.pop()[0]
                places.append((i, j))
            for i, j in reversed(places):
                bits, mapping, x = self.best(run[i:j])
                if bits >= self.least:
                    new, name = new[:i] + x + new[j:], mapping
            odd = bool(places)
            got = self.runs[run] = (new, name, odd)
        return got

    def restore(self, text: str) -> tuple[str, list[str], int]:
        """(restored text, names of the mappings used, characters that are lost for good).  No name and no loss: the text is sound."""
        names, out, at, odd = set(), [], 0, []
        for m in _RUN.finditer(text):
            x, y = m.span()
            x0, y0 = max(0, x - 1), min(len(text), y + 1)
            new, name, improbable = self.repair(text[x0:y0])
            if name:
                names.add(name)
                out += [text[at:x], new[x - x0 : len(new) - (y0 - y)]]
                at = y
            elif improbable:
                odd.append(text[x0:y0])
        if names:
            return self.rest("".join([*out, text[at:]]), names), sorted(names), text.count(_LOST)
        new, name = self.swap(text, odd) if odd else (text, "")
        return new, [name] if name else [], text.count(_LOST)

    def rest(self, text: str, names: set[str]) -> str:
        """Runs too rare to tell by themselves, undone by the mappings that the text is known to need."""
        used = [t for n, t in self.multi if any(x.split(",")[0] == n for x in names)]
        out, at = [], 0
        for m in _RUN.finditer(text):
            x, y = max(0, m.start() - 1), min(len(text), m.end() + 1)
            run = text[x:y]
            for table in used:
                new = self.undo(run, table)
                if new != run and self.known(new, "") and self.model.cost(run) - self.model.cost(new) > -8:
                    out += [text[at : m.start()], new[m.start() - x : len(new) - (y - m.end())]]
                    at = m.end()
                    break
        return "".join([*out, text[at:]])

    def swap(self, text: str, odd: list[str]) -> tuple[str, str]:
        """8-bit text read as other 8-bit text: one mapping for the whole text, judged by all its non-ASCII runs.

        It must save enough bits over all of them, no run may become much less likely, and one that becomes likelier must hold
        a character that can't stand where it does (:func:`misplaced`), for which rare but sound letters would pass too.
        """
        top = (self.least_swap, "", None)
        for name, table in self.single:
            if not any(c in table for run in odd for c in run):
                continue
            bits, wrong = 0.0, False
            for m in _RUN.finditer(text):
                run = text[max(0, m.start() - 1) : m.end() + 1]
                if (saved := self.saved.get((name, run))) is None:
                    if len(self.saved) > 200_000:
                        self.saved.clear()
                    new = "".join(table.get(c, c) for c in run)
                    saved = self.saved[name, run] = 0.0 if new == run else self.model.cost(run) - self.model.cost(new) if self.known(new, "") else -99.0
                if saved < -9:
                    break
                bits += saved
                wrong = wrong or (saved > 2 and any(c in table and misplaced(a, c, b) for a, c, b in zip(" " + run, run, run[1:] + " ")))
            else:
                if wrong and bits > top[0]:
                    top = (bits, name, table)
        return ("".join(top[2].get(c, c) for c in text), top[1]) if top[2] else (text, "")


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text", least_gain: float = 1.0, least_swap: float = 8.0) -> DataFrame:
    """Garbled documents: key, mapping(s), restored text, restorable (no character is lost), n_lost.

    The statistics cover all characters of all documents; their size is bounded by the alphabet (characters above U+3000
    by block), so the model travels as a broadcast.  NULL, empty and pure-ASCII texts are sound.  A text of any length is
    one pass; repeated rows are reported each.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    model = PairModel.of(char_pairs(docs, text).toPandas())
    shared = spark.sparkContext.broadcast(model)

    def scan(batches):
        fix = Restorer(shared.value, least_gain, least_swap)
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and not t.isascii():
                    new, names, lost = fix.restore(t)
                    if names or lost:
                        rows.append((k, ", ".join(names) or None, new, not lost, lost))
            c = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(c, [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32()])], names=[key, "mapping", "restored", "restorable", "n_lost"])

    return docs.select(key, text).mapInArrow(scan, f"{key} long, mapping string, restored string, restorable boolean, n_lost int")
