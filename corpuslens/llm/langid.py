"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The learning sample: so many documents of each language, the smallest hash of each residue, and so many
#: characters from the start of each. The rest of the labelled rows is not read; all documents are classified.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 256
#: Parsing starts a new phrase after so many characters, so that long texts are parsed side by side.
PIECE = 512
UND = "und"


#: Runs of letters (the few signs that count as numbers though they are no digits stay in).
LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> str:
    """Lower case; all that is no letter becomes one blank. Empty if there is no letter at all."""
    found = " ".join(LETTERS.findall(text.lower()))
    return found if any(map(str.isalpha, found)) else ""


class Automaton:
    """Suffix automaton of one language's text as a dense table ``step[state, symbol]`` (0: no such step, state 1 is the start)."""

    def __init__(self, text: str, symbols: dict[str, int]):
        link, longest, nexts = [-1], [0], [{}]
        last = 0
        for c in text:
            now = len(nexts)
            link.append(0), longest.append(longest[last] + 1), nexts.append({})
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = now
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if longest[p] + 1 == longest[q]:
                    link[now] = q
                else:
                    copy = len(nexts)
                    link.append(link[q]), longest.append(longest[p] + 1), nexts.append(dict(nexts[q]))
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        self.width = len(symbols) + 1
        self.step = np.zeros((len(nexts) + 1) * self.width, np.int32)  # holds the row's offset of the next state
        for state, go in enumerate(nexts):
            for c, to in go.items():
                self.step[(state + 1) * self.width + symbols[c]] = (to + 1) * self.width

    def phrases(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Number of longest-match phrases of each piece ``codes[start : start + length]``; longest pieces first.

        Greedy: a phrase runs on while it occurs in the language's text; a symbol that never occurs is one phrase.
        """
        again = np.maximum(self.step[self.width : 2 * self.width], self.width)
        state = np.full(len(start), self.width, np.int32)
        count = np.zeros(len(start), np.int32)
        alive = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for t, n in enumerate(alive):
            c = codes[start[:n] + t]
            to = self.step[state[:n] + c]
            missed = np.flatnonzero(to == 0)
            count[:n] += (to == 0) | (state[:n] == self.width)  # a phrase begins
            to[missed] = again[c[missed]]
            state[:n] = to
        return count


class Model:
    """Automata by language. A language is scored by its phrases, each weighed by the log of its text's length."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(k for k, v in texts.items() if v)
        alphabet = sorted({c for k in self.langs for c in texts[k]})
        self.symbols = {c: i + 1 for i, c in enumerate(alphabet)}
        # one code for each code point up to the last learned one, and one for all that lie above
        self.codes = np.zeros(ord(alphabet[-1]) + 2 if alphabet else 1, np.uint8 if len(alphabet) < 255 else np.uint16 if len(alphabet) < 1 << 16 else np.uint32)
        for c, i in self.symbols.items():
            self.codes[ord(c)] = i
        self.automata = [Automaton(texts[k], self.symbols) for k in self.langs]
        self.weight = np.array([np.log2(max(2, len(texts[k]))) for k in self.langs])

    def entropy(self, texts: list[str]) -> np.ndarray:
        """(texts x languages): weighed phrases for each character, the cross-parsing estimate of bits a character."""
        if not self.langs:
            return np.zeros((len(texts), 0))
        at = np.cumsum([0, *map(len, texts)])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes[np.minimum(points, len(self.codes) - 1)]
        owner = np.repeat(np.arange(len(texts)), -(-np.diff(at) // PIECE))
        piece = np.arange(len(owner)) - np.searchsorted(owner, owner)
        start = at[owner] + piece * PIECE
        length = np.minimum(at[owner + 1] - start, PIECE)
        order = np.argsort(-length, kind="stable")
        out = np.zeros((len(texts), len(self.langs)))
        for k, automaton in enumerate(self.automata):
            count = automaton.phrases(codes, start[order], length[order])
            out[:, k] = np.bincount(owner[order], weights=count, minlength=len(texts)) * self.weight[k] / np.maximum(np.diff(at), 1)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and bits a character of each text."""
        clean = [letters(t) if t else "" for t in texts]
        bits = self.entropy(clean)
        out = []
        for text, b in zip(clean, bits):
            if not text or not len(b):
                out.append((UND, 0.0, 0.0))
                continue
            k = int(np.argmin(b))  # ties: the language that comes first
            second = np.partition(b, 1)[1] if len(b) > 1 else np.inf
            out.append((self.langs[k], float(min(1.0, max(0.0, 1 - b[k] / second))), float(b[k])))
        return out


def held_out(doc_id):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 3, is 1 (a null id: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Learns from documents that are not held out and have a language. The sample is bounded as stated above.

    A language's sample is one document for each of SAMPLE_DOCS residues, picked by a ``min`` that folds before the
    shuffle, so that a language with most of all rows costs no more than another.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    hashed = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"))
    picked = hashed.groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("part")).agg(F.min(F.struct("h", "doc_id")).alias("m"))
    ids = sorted({r[0] for r in picked.select("m.doc_id").collect()})
    head = F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS)
    # rows that repeat an id fold to one, so that what comes to the driver is bounded by the languages; no text is shuffled
    rows = usable.where(F.col("doc_id").isin(ids)).groupBy("lang", "doc_id").agg(F.min(head).alias("text"))
    texts: dict[str, str] = {}
    for lang, _, text in sorted(map(tuple, rows.collect())):
        texts[lang] = f"{texts.get(lang, '')} {letters(text)}".strip()
    return Model(texts)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, batch: int = 4096) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score and bits; bits are the best language's bits a character.

    Null texts, texts without a letter and an empty model give ``und`` with score 0. Only the text decides. Ties go
    to the language that comes first in order. Columns of these names in the input are replaced. Rows are parsed
    whole and side by side, ``batch`` rows at a time. The model travels with the tasks; its size is bounded by
    SAMPLE_DOCS x SAMPLE_CHARS a language.
    """
    added = ("lang_pred", "score", "bits")
    keep = [c for c in (keep or docs.columns) if c not in added]
    docs = docs.select("text", *[c for c in keep if c != "text"])
    fields = [f for f in docs.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, batch):
                rows = whole.slice(i, batch)
                found = model.predict(rows.column(rows.schema.get_field_index("text")).to_pylist())
                columns = [rows.column(rows.schema.get_field_index(f.name)) for f in fields]
                columns += [pa.array([x[k] for x in found], t) for k, t in ((0, pa.string()), (1, pa.float64()), (2, pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields] + list(added))

    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    return docs.mapInArrow(run, schema)
