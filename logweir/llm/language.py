"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is trained.  A text is parsed into the longest
phrases that occur in a language's training text; the language that needs the fewest phrases for each
letter wins.  The automata become transition tables, so that many stretches of text are parsed in step, one
lookup for each character and language: in a dense table for the commonest letters, by binary search among the
transitions there are for all others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.samples import class_sample

#: Documented bound of what is learned from: rows of each language, whose texts are taken whole.
TEXTS_PER_LANGUAGE = 32
STRETCH = 512
#: Letters with a column in the dense tables, and entries of all languages' tables together, at most.
DENSE, DENSE_ENTRIES = 128, 1 << 25


class Alphabet:
    """Classes of characters: 0 for what isn't a letter, then all letters of the training text by frequency, last the rest."""

    def __init__(self, texts: Iterable[str]):
        counts: dict[str, int] = {}
        for text in texts:
            for ch in set(text.lower()):
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        self.size = len(letters) + 2
        self.table = np.zeros(0x110000, np.int32)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                self.table[i] = self.size - 1
        for k, ch in enumerate(letters):
            self.table[ord(ch)] = k + 1
            if len(ch.upper()) == 1:
                self.table[ord(ch.upper())] = k + 1

    def codes(self, text: str) -> np.ndarray:
        """Classes of a text's characters, with runs of non-letters as one."""
        c = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if len(c):
            c = c[(c > 0) | (np.concatenate([[1], c[:-1]]) > 0)]
        return c


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``, for each state; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class ParseTable:
    """Where a parse goes from a state on a character, times two, plus one where a phrase begins with it.

    A phrase ends where the automaton has no transition, and the character begins the next.  The last state
    is the one before the first phrase, and after a character that doesn't occur in the training text,
    which is a phrase of its own.
    """

    def __init__(self, nxt: list[dict[int, int]], size: int, entries: int = DENSE_ENTRIES):
        self.size, self.none = size, len(nxt)
        self.columns = max(1, min(DENSE, size, entries // (len(nxt) + 1)))
        rows = sorted((s * size + c, 2 * t) for s, to in enumerate(nxt) for c, t in to.items())
        self.__setstate__(self.__dict__ | {"moves": (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32))})

    def __getstate__(self) -> dict:
        """Only the transitions there are; each worker makes its tables of them."""
        return {k: v for k, v in self.__dict__.items() if k in ("size", "none", "columns", "moves")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        moves, goals = self.moves
        states, codes = moves // self.size, moves % self.size
        first = states == 0
        self.begin = np.full(self.size, 2 * self.none + 1, np.int32)
        self.begin[codes[first]] = goals[first] + 1
        dense = np.tile(self.begin[: self.columns], (self.none + 1, 1))
        common = codes < self.columns
        dense[states[common], codes[common]] = goals[common]
        self.dense = dense.ravel()
        self.keys, self.goals = moves[~common], goals[~common]

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        to = self.dense[state * self.columns + np.minimum(code, self.columns - 1)]
        rare = np.flatnonzero(code >= self.columns)
        if len(rare):
            c = code[rare]
            to[rare] = self.begin[c]
            if len(self.keys):
                asked = state[rare].astype(np.int64) * self.size + c
                at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
                known = self.keys[at] == asked
                to[rare[known]] = self.goals[at[known]]
        return to


class LanguageModel:
    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        self.alphabet = Alphabet(t for ts in texts.values() for t in ts)
        self.tables = []
        for lang in self.languages:
            codes = np.concatenate([self.alphabet.codes(t + "\n") for t in texts[lang]])
            self.tables.append(ParseTable(suffix_automaton(codes), self.alphabet.size, DENSE_ENTRIES // len(self.languages)))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and letters of each text.

        Texts are cut into stretches of a fixed length that are parsed in step; a cut ends a phrase.
        """
        coded = [self.alphabet.codes(t) for t in texts]
        letters = np.array([np.count_nonzero(c) for c in coded], np.int64)
        owner, stretches = [], []
        for i, c in enumerate(coded):
            for at in range(0, len(c), STRETCH):
                owner.append(i)
                stretches.append(c[at : at + STRETCH])
        counts = np.zeros((len(self.languages), len(texts)), np.int64)
        if not stretches:
            return counts, letters
        lengths = np.array([len(s) for s in stretches])
        order = np.argsort(-lengths, kind="stable")
        owner_, lengths = np.array(owner)[order], lengths[order]
        grid = np.zeros((STRETCH, len(stretches)), np.int32)
        for column, k in enumerate(order):
            grid[: lengths[column], column] = stretches[k]
        alive = np.searchsorted(-lengths, -np.arange(STRETCH), side="left")  # stretches longer than step
        for k, table in enumerate(self.tables):
            state = np.full(len(stretches), table.none, np.int32)
            begun = np.zeros(len(stretches), np.int64)
            for step in range(STRETCH):
                n = alive[step]
                if not n:
                    break
                to = table.step(state[:n], grid[step, :n])
                begun[:n] += to & 1
                state[:n] = to >> 1
            counts[k] = np.bincount(owner_, begun, len(texts)).astype(np.int64)
        return counts, letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts, letters = self.phrases([t or "" for t in texts])
        out = []
        for i, n in enumerate(letters.tolist()):
            if not n or not self.languages:
                out.append(("und", 0.0))
                continue
            rates = counts[:, i] / n
            order = np.argsort(rates, kind="stable")
            best, second = rates[order[0]], rates[order[1]] if len(order) > 1 else 1.0
            out.append((self.languages[order[0]], float(1 - best / second) if second > 0 else 0.0))
        return out


def train_language(rows: DataFrame, label: str = "lang", per_class: int = TEXTS_PER_LANGUAGE) -> LanguageModel:
    """A model of the languages in ``rows`` (doc_id, text, ``label``), from about ``per_class`` whole texts of each.

    Rows with a null label or text teach nothing; without any row the model knows no language and all is ``und``.
    """
    return LanguageModel(class_sample(rows, label, per_class)[0])


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every whole text of ``docs`` (doc_id, text).

    The score is how much fewer phrases the language needs than the runner-up, as a share (0 to 1).  A
    null text, or one without a letter, is ``und`` with score 0.  Of languages that need equally many the
    first by code point wins.  Texts of any length are parsed to the end.  Repeated rows give repeated
    results, an empty table none; other columns are not read.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # the transitions of the sampled texts, a few for each character

    def identify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "lang_pred", "score"]
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # some millions of characters in memory at a time
                texts, size, to = [], 0, at
                while to < batch.num_rows and size < 4_000_000:
                    t = batch.column(1)[to].as_py()
                    size, to = size + len(t or ""), to + 1
                    texts.append(t)
                found = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names)
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(identify, "doc_id long, lang_pred string, score double")
