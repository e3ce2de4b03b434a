"""SentencePiece encoding and decoding of whole texts, for models that merge (BPE) and have byte pieces.

A text gets the model's dummy space in front and its spaces become U+2581. Such
a model merges the adjacent pair whose joint piece scores best, leftmost first.
The same result is found by backtracking. An Aho-Corasick automaton gives the longest piece
that begins at each position; from the left, pieces are tried from the
longest to the shortest, a piece must be compatible with the one before it, and a
position from which none leads on is marked in a bitfield and never tried again.
Two pieces are compatible if merging their joint characters gives just these two.
Where all neighbours are compatible no merge can cross a boundary, so the sequence
is the one that merging gives, and any left part of a text has but one such sequence.

Texts are cut first where no piece of the model joins what meets: before spaces, around line ends, between
letters and marks. Only distinct cuts that aren't kept are encoded. Characters that no piece holds give their bytes.

Null texts count as empty and give no ids. Repeated rows, equal texts and null ids are
kept as they are, very long texts are encoded in runs of about four million code points, an empty table gives an
empty result, and other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tokens import joined

SPACE = "▁"
LETTER, MARK = "[A-Za-z\u00c0-\u00d6\u00d8-\u024f]", r"[!-/:-@\[-`{-~]"
#: Where texts are cut, and where cuts are cut again, unless a piece of the model holds both sides.
COARSE = [rf"([^{SPACE}\n])([{SPACE}\n])", rf"(\n)([^\n])"]
FINE = [rf"({LETTER})({MARK})", rf"({MARK})({LETTER})"]
#: Bytes of kept cuts and their ids; beyond it all are dropped.
KEPT_BYTES = 24 << 20
#: Pairs of pieces whose compatibility is kept.
KEPT_PAIRS = 1 << 20
#: Code points that are cut at once.
RUN = 1 << 22
#: What the library writes for the unknown piece.
UNKNOWN = " ⁇ "
NONE = -np.inf


class PieceModel:
    """Pieces, scores and bytes of a model file."""

    def __init__(self, file: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        read = SentencePieceProcessor(model_file=file)
        n = read.get_piece_size()
        self.names = [read.id_to_piece(k) for k in range(n)]
        byte = [k for k in range(n) if read.is_byte(k)]
        plain = [k for k in range(n) if not (read.is_byte(k) or read.is_control(k) or read.is_unknown(k))]
        if len(byte) != 256 or any(read.is_unused(k) for k in plain):
            raise ValueError("a model with byte pieces and without unused ones is needed")
        self.byte_id = [byte[k] for k in np.argsort([int(self.names[k][3:5], 16) for k in byte])]
        self.score = {self.names[k]: read.get_score(k) for k in plain}
        self.held = held = set("".join(self.score))
        if "\0" in held:
            raise ValueError("a piece holds a zero, which marks cuts")
        self.coarse, self.fine = ([x for x in cuts if not any(re.search(x, name) for name in self.score)] for cuts in (COARSE, FINE))
        #: Characters of longer pieces that are no piece themselves get a number beyond the pieces; they stand for their bytes.
        self.names += sorted(c for c in held if c not in self.score)
        self.size = n
        number = {name: k for k, name in enumerate(self.names) if name in self.score or k >= n}
        self.length = [len(x) for x in self.names]
        self.automaton = ahocorasick.Automaton()
        for name, k in number.items():
            if self.merged(name) == [name]:
                self.automaton.add_word(name, (len(name) - 1, k))
        self.automaton.make_automaton()
        #: The longest piece that is a shorter prefix, or -1.
        self.shorter = [-1] * len(self.names)
        for name, k in number.items():
            fits = (name[:m] for m in range(len(name) - 1, 0, -1))
            self.shorter[k] = next((number[x] for x in fits if self.automaton.exists(x)), -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.forget()
        # decoding
        surface = [x.replace(SPACE, " ") for x in self.names[:n]]
        raw = [x.encode() for x in surface]
        for k in range(n):
            if read.is_control(k):
                raw[k] = b""
            elif read.is_unknown(k):
                raw[k] = UNKNOWN.encode()
        for value, k in enumerate(self.byte_id):
            raw[k] = bytes([value])
        self.raw = pa.array(raw, pa.binary())
        self.leading = np.array([x.startswith(SPACE) for x in self.names[:n]])
        self.silent = np.array([not x for x in raw])
        self.bytes = np.zeros(n, bool)
        self.bytes[byte] = True

    def forget(self) -> None:
        """Drop all kept cuts, as a task does at its end."""
        self.kept, self.ids, self.offsets = pa.array([], pa.string()), np.empty(0, np.int32), np.zeros(1, np.int64)

    def merged(self, text: str) -> list[str]:
        """Characters merged as the model does: the best joint score first, the leftmost of equals."""
        parts, score = list(text), self.score
        joint = [score.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while joint and (best := max(joint)) > NONE:
            k = joint.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joint[k]
            if k:
                joint[k - 1] = score.get(parts[k - 1] + parts[k], NONE)
            if k < len(joint):
                joint[k] = score.get(parts[k] + parts[k + 1], NONE)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether two pieces stay apart when their characters are merged again."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        x, y = self.names[a], self.names[b]
        self.pairs[a, b] = found = self.merged(x + y) == [x, y]
        return found

    def backtracked(self, text: str) -> list[int]:
        """The pieces of a text of characters that pieces hold."""
        n, pairs, length, shorter = len(text), self.pairs, self.length, self.shorter
        longest = [-1] * (n + 1)
        for end, (back, k) in self.automaton.iter(text):  # ends ascend, so that the longest comes last
            longest[end - back] = k
        failed = bytearray(n // 8 + 1)
        found: list[int] = []
        at, k, last = 0, longest[0], -1
        while at < n:
            end = at + length[k]
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits and last >= 0:
                fits = pairs.get((last, k))
                if fits is None:
                    fits = self.compatible(last, k)
            if fits:
                found.append(k)
                at, k, last = end, longest[end], k
            elif shorter[k] >= 0:
                k = shorter[k]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                k = found.pop()
                at, last = at - length[k], found[-1] if found else -1
        return found

    def spelt(self, text: str) -> list[int]:
        """Ids of a text; a character that no piece holds gives its bytes and merges with nothing."""
        if self.held.issuperset(text):
            found = self.backtracked(text)
            return found if max(found, default=0) < self.size else [y for x in found for y in ([x] if x < self.size else [self.byte_id[v] for v in self.names[x].encode()])]
        out: list[int] = []
        for strange, part in groupby(text, lambda c: c not in self.held):
            part = "".join(part)
            out += [self.byte_id[v] for v in part.encode()] if strange else self.spelt(part)
        return out

    def known(self, cuts: pa.Array) -> np.ndarray:
        """Places of distinct cuts among the kept ones; new ones are encoded first."""
        if self.kept.nbytes + self.ids.nbytes > KEPT_BYTES:
            self.forget()
        at = pc.fill_null(pc.index_in(cuts, value_set=self.kept), -1).to_numpy().copy()
        if len(new := np.flatnonzero(at < 0)):
            at[new] = len(self.kept) + np.arange(len(new))
            more = cuts.take(pa.array(new))
            each = [self.spelt(x) for x in more.to_pylist()]
            self.kept = pa.concat_arrays([self.kept, more])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(each), np.int32)])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in each])])
        return at

    def run(self, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts with marked spaces, one behind the other, and the borders of the texts."""
        lists, cuts = cut(marked, self.coarse)
        finer, pieces = cut(cuts.dictionary, self.fine)
        at = self.known(pieces.dictionary)[pieces.indices.to_numpy()]
        ids, borders = joined(finer, self.ids, self.offsets, at)
        return joined(lists, ids, borders, cuts.indices.to_numpy())

    def encode(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text; a long one is cut into runs like a batch of short ones."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        run: list[tuple[int, str]] = []
        size = 0

        def flush():
            nonlocal run, size
            ids, borders = self.run(pa.array([t for _, t in run], pa.string()))
            for (k, _), a, b in zip(run, borders, borders[1:]):
                out[k].append(ids[a:b])
            run, size = [], 0

        for k, text in enumerate(texts):
            marked = SPACE + text.replace(" ", SPACE) if text else ""
            if "\0" in marked:  # the mark of cuts
                out[k].append(np.array(self.spelt(marked), np.int32))
                continue
            at = 0
            while at < len(marked):
                end = at + RUN
                while end < len(marked) and not (marked[end] == SPACE and marked[end - 1] != SPACE):
                    end += 1
                run.append((k, marked[at:end]))
                size, at = size + min(end, len(marked)) - at, end
                if size >= RUN:
                    flush()
        if run:
            flush()
        flat = [x for parts in out for x in parts]
        borders = np.cumsum([0, *(sum(len(x) for x in parts) for parts in out)])
        return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *flat]), pa.int32()))

    def decode(self, lists: pa.ListArray) -> list[str]:
        """Texts of lists of ids: pieces one behind the other without the first one's space, bytes as UTF-8 (U+FFFD for each byte that is none)."""
        borders, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
        parts = self.raw.take(pa.array(ids))
        whole = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, parts), b"").to_pylist()
        sounding = np.flatnonzero(~self.silent[ids])
        first = np.searchsorted(sounding, borders[:-1])
        out = []
        for text, a, b, f in zip(whole, borders[:-1], borders[1:], first):
            k = sounding[f] if f < len(sounding) else b
            if k < b and self.leading[ids[k]]:
                text = text[1:]
            try:
                out.append(text.decode())
            except UnicodeDecodeError:
                out.append(self.mended(ids[a:b]))
        return out

    def mended(self, ids: np.ndarray) -> str:
        """One text with bytes that are no UTF-8: each run of byte pieces is read by itself."""
        edges = np.flatnonzero(np.diff(self.bytes[ids])) + 1
        text, seen = "", False
        for run in np.split(ids, edges):
            if self.bytes[run[0]]:
                text += by_byte(b"".join(self.raw[int(k)].as_py() for k in run))
                continue
            for k in run:
                piece = self.raw[int(k)].as_py().decode()
                text += piece[1:] if self.leading[k] and not seen and not text else piece
                seen |= bool(self.leading[k])
        return text


def cut(texts: pa.Array, patterns: list[str]) -> tuple[pa.ListArray, pa.DictionaryArray]:
    """The cuts of each text, and all of them by their distinct ones."""
    for x in patterns:
        texts = pc.replace_substring_regex(texts, x, "\\1\0\\2")
    lists = pc.split_pattern(texts, "\0")
    return lists, lists.flatten().dictionary_encode()


def by_byte(raw: bytes) -> str:
    """UTF-8, with U+FFFD for every single byte that belongs to no character."""
    text = ""
    while raw:
        try:
            return text + raw.decode()
        except UnicodeDecodeError as error:
            text += raw[: error.start].decode() + "�"
            raw = raw[error.start + 1 :]
    return text


@lru_cache(2)
def piece_model(file: str) -> PieceModel:
    return PieceModel(file)


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int> of the whole text, without begin or end ids)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def work(batches):
        model = piece_model(file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), model.encode(batch.column(1).to_pylist())], ["doc_id", "ids"])
        model.forget()

    return rows.mapInArrow(work, "doc_id long, ids array<int>")


def decode(coded: DataFrame, file: str) -> DataFrame:
    """Add decoded: the text of ids. Null ids count as none."""

    def work(batches):
        model = piece_model(file)
        for batch in batches:
            ids = batch.columns[-1]
            texts = model.decode(pa.ListArray.from_arrays(*flat(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    rows = coded.select(*[c for c in coded.columns if c != "ids"], F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(work, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", decoded string")


def flat(ids: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Offsets from 0 and values of a list array, which may be a slice."""
    lengths = pc.list_value_length(ids).to_numpy()
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), ids.flatten()
