"""Token ids from public vocabulary files, inside tasks.

LibraryEncoder uses the tokenizers library on a JSON file. A byte-level
pre-token never runs from text into a following space or line end, so a text cut
before these gives parts that encode independently, unless three white-space
characters (or the last two) stand together; such texts go to the library
whole, and so do those that may hold a special token. Distinct parts are cut again behind letters
and digits, where pre-tokens always end, and only distinct pieces that aren't kept go to the library, many
in one text with a special token between them. Pieces and their ids are Arrow and numpy
arrays, kept within a bound of bytes until the task ends.
RankEncoder uses the tiktoken library on a rank file.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Three white-space characters, or two at the end.
TANGLED = rf"{SPACE}{SPACE}(?:{SPACE}|\z)"
#: A Latin letter before a mark or digit (an apostrophe too, for what it begins is a pre-token of its own), a digit before a mark or letter.
ENDS = (r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])([!-@\[-`{-~])", r"([0-9])([!-/:-~])")
#: Bytes of kept pieces and their ids; beyond it all are dropped.
KEPT_BYTES = 24 << 20
#: Code points that are cut into parts at once.
RUN = 1 << 22
#: Pieces that go to the library in one text.
JOINED = 500


def gathered(ids: np.ndarray, offsets: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the named rows, one behind the other, and their offsets; row k holds ids[offsets[k]:offsets[k + 1]]."""
    lengths = np.diff(offsets)[names]
    out = np.concatenate([[0], np.cumsum(lengths)])
    return ids[np.arange(out[-1]) + np.repeat(offsets[names] - out[:-1], lengths)], out


def joined(lists: pa.ListArray, ids: np.ndarray, offsets: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for each list of rows."""
    ids, out = gathered(ids, offsets, names)
    return ids, out[lists.offsets.to_numpy()]


class LibraryEncoder:
    """Texts to ids by the tokenizers library, as little-endian unsigned 32-bit integers."""

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [x.content for x in added.values()]
        #: A special token that takes nothing of its neighbours: id and string.
        self.between = next(((k, x.content) for k, x in sorted(added.items()) if x.special and not (x.lstrip or x.rstrip or x.single_word)), None)
        self.forget()

    def forget(self) -> None:
        """Drop all kept pieces, as a task does at its end."""
        self.kept, self.ids, self.offsets = pa.array([], pa.string()), np.empty(0, "<u4"), np.zeros(1, np.int64)
        pa.default_memory_pool().release_unused()

    @property
    def size(self) -> int:
        """Bytes of kept pieces and their ids."""
        return self.kept.nbytes + self.ids.nbytes + self.offsets.nbytes if len(self.kept) else 0

    def library(self, texts: list[str]) -> list[np.ndarray]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(x.ids, "<u4") for x in run(texts, add_special_tokens=False)]

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without special tokens, one behind the other, and the number of each."""
        if self.between:
            mark, text = self.between
            groups = [pieces[k : k + JOINED] for k in range(0, len(pieces), JOINED)]
            ids = np.concatenate(self.library([text.join(x) + text for x in groups]))
            ends = np.flatnonzero(ids == mark)
            if len(ends) == len(pieces):
                return ids[ids != mark], np.diff(ends, prepend=-1) - 1
        each = self.library(pieces)
        return np.concatenate(each), np.array([len(x) for x in each])

    def known(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces among the kept ones; new ones are kept first."""
        if self.size > KEPT_BYTES:
            self.forget()
        at = pc.fill_null(pc.index_in(pieces, value_set=self.kept), -1).to_numpy()
        if len(new := np.flatnonzero(at < 0)):
            at = at.copy()
            at[new] = len(self.kept) + np.arange(len(new))
            more = pieces.take(pa.array(new))
            ids, counts = self.encoded(more.to_pylist())
            self.kept = pa.concat_arrays([self.kept, more])
            self.ids = np.concatenate([self.ids, ids])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
        return at

    def run(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that can be cut: those of the distinct pieces of distinct parts, put together twice."""
        marked = pa.array(texts, pa.string())
        for x in " \n":
            marked = pc.replace_substring(marked, x, "\0" + x)
        lists = pc.split_pattern(marked, "\0")
        parts = lists.flatten().dictionary_encode()
        marked = parts.dictionary
        for x in ENDS:
            marked = pc.replace_substring_regex(marked, x, "\\1\0\\2")
        finer = pc.split_pattern(marked, "\0")
        pieces = finer.flatten().dictionary_encode()
        at = self.known(pieces.dictionary)[pieces.indices.to_numpy()]
        ids, offsets = joined(lists, *joined(finer, self.ids, self.offsets, at), parts.indices.to_numpy())
        return [ids[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]

    def whole(self, texts: list[str]) -> list[bool]:
        """Whether a text must go to the library uncut: white space stands together, or it may hold a special token."""
        tangled = pc.match_substring_regex(pa.array(texts, pa.string()), TANGLED).to_pylist()
        return [x or "\0" in t or any(s in t for s in self.special) for t, x in zip(texts, tangled, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; a long one is cut into runs of parts like a batch of short ones."""
        out: list[list[bytes]] = [[] for _ in texts]
        run: list[tuple[int, str]] = []  # places of texts and their pieces, which begin before a space
        size = 0

        def flush():
            nonlocal run, size
            for (k, _), ids in zip(run, self.run([t for _, t in run]), strict=True):
                out[k].append(ids)
            run, size = [], 0

        for k, (text, whole) in enumerate(zip(texts, self.whole(texts), strict=True)):
            if whole:
                out[k].append(self.library([text])[0].tobytes())
                continue
            at = 0
            while at < len(text):
                end = text.find(" ", at + RUN) if len(text) - at > RUN else -1
                end = len(text) if end < 0 else end
                run.append((k, text[at:end]))
                size, at = size + end - at, end
                if size >= RUN:
                    flush()
        if run:
            flush()
        return [b"".join(x) for x in out]


class RankEncoder:
    """Texts to ids and back by the tiktoken library."""

    def __init__(self, file: str, pattern: str):
        import tiktoken

        with open(file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def decode(self, ids: bytes) -> bytes:
        return self.encoding.decode_bytes(np.frombuffer(ids, "<u4").tolist())


@lru_cache(4)
def library_encoder(file: str) -> LibraryEncoder:
    return LibraryEncoder(file)


@lru_cache(4)
def rank_encoder(file: str, pattern: str) -> RankEncoder:
    return RankEncoder(file, pattern)
