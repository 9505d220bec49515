"""The byte-level BPE's splitting of text into pieces, vectorised over code points, with a memo of each piece's ids.

The pieces are those of the published pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
A piece's ids don't depend on its neighbours, so each distinct piece is merged once per worker. The vocabulary is
read from the tokenizers file; its ids rise in the order of its merges, so tiktoken's merging by lowest rank gives
the same ids, at a tenth of the cost a piece. tests/llm hold it against the tokenizers library.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
import tiktoken

from . import common as C

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: What may follow an apostrophe in a contraction, longest first where one begins another.
CONTRACTIONS = ("re", "ve", "ll", "s", "t", "m", "d")
#: Pieces whose ids a worker keeps; when there are more, or they are long, it starts anew.
MEMO = 1 << 18


def classes() -> np.ndarray:
    """The class of every code point."""
    held = C._WORKER.get("classes")
    if held is None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        held = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = ord(m[0][0]), ord(m[0][-1])
                held[a : b + 1] = kind
        held[0xD800:0xE000] = OTHER
        C._WORKER["classes"] = held
    return held


def pieces(text: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sorted starts of the pieces of the texts whose code points are joined in `text` and begin at `cuts`."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[text]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    first = np.zeros(n + 1, bool)
    first[cuts] = True
    first[n] = True
    new |= first[:-1]
    # the last of a run of white space that other text follows stands alone, or begins the next piece if it is a blank
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:-1]) if n > 1 else np.zeros(0, np.int64)
    blank = last[text[last] == 32]
    new[last] = True
    new[blank + 1] = False
    # contractions: an apostrophe alone in its run that no blank precedes
    marks = np.flatnonzero((text == 39) & new)
    for at in marks.tolist():
        if at + 1 >= n or kind[at + 1] != LETTER or first[at + 1] or not new[at + 1]:
            continue
        for tail in CONTRACTIONS:
            end = at + 1 + len(tail)
            if end <= n and not first[at + 1 : end].any() and all(text[at + 1 + k] == ord(x) for k, x in enumerate(tail)):
                new[at + 1] = False
                if end < n:
                    new[end] = True
                break
    return np.flatnonzero(new)


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def merge_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a byte-level BPE file and their ids; raises if the ids don't rise with the merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("ids don't rise with the merges")
    kept = {*made, *(vocab[c] for c in byte)}
    return {bytes(byte[c] for c in w): i for w, i in vocab.items() if i in kept}


def added_tokens(path: str) -> dict[bytes, int]:
    """The file's added tokens, which are found in a text before its pieces are made; raises for rules not built here."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", [])
    if any(x.get(k) for x in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token with rules of its own")
    return {x["content"].encode(): x["id"] for x in found}


class Encoder:
    """Token ids of many texts at once."""

    def __init__(self, path: str):
        self.model = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=merge_ranks(path), special_tokens={})
        self.added = added_tokens(path)
        self.marks = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) or b"(?!)")
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.spelled = np.zeros(0, np.uint32)
        self.begins = np.zeros(0, np.int64)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        got = [self.model.encode_ordinary(w) for w in words]
        lengths = np.array([len(x) for x in got], np.int64)
        begin = len(self.ids)
        self.ids = np.concatenate([self.ids, np.array([i for x in got for i in x], np.uint32)])
        rows = np.arange(len(self.starts), len(self.starts) + len(got))
        self.starts = np.concatenate([self.starts, begin + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        sizes = np.array(list(map(len, words)), np.int64)
        self.begins = np.concatenate([self.begins, len(self.spelled) + np.cumsum(sizes) - sizes])
        self.spelled = np.concatenate([self.spelled, np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as UTF-8, joined, and their n + 1 offsets."""
        begins = (data & 0xC0) != 0x80  # a code point's first byte
        chars = np.concatenate([[0], np.cumsum(begins)])[offsets]
        text = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = pieces(text, chars[:-1][chars[:-1] < len(text)])
        ends = np.append(starts[1:], len(text)).astype(np.int64)
        hashes = C.span_hashes(C.mix(text.astype(np.uint64) + np.uint64(1)), starts, ends)
        kept, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, kept)
        known = np.zeros(len(kept), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == kept
        if not known.all():
            if len(self.keys) + int((~known).sum()) > MEMO or len(self.spelled) > 8 * MEMO:
                self.reset()
                known[:] = False
            new = where[~known]
            whole = text.tobytes().decode("utf-32-le")
            self.learn(kept[~known], [whole[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.keys, kept)
        rows = self.rows[at][back] if len(kept) else np.zeros(0, np.int64)
        # the memo's pieces are compared themselves: hashes only lead to them
        if not np.array_equal(self.spelled[C.ragged(ends - starts, self.begins[rows])], text):
            whole = text.tobytes().decode("utf-32-le")
            got = [self.model.encode_ordinary(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            total = np.cumsum([0, *map(len, got)])
            return np.array([i for x in got for i in x], np.uint32), total[np.searchsorted(starts, chars)]
        lengths = self.lengths[rows]
        ids = self.ids[C.ragged(lengths, self.starts[rows])]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.searchsorted(starts, chars)]


    def encode_added(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode(), with the file's added tokens in the texts as their own ids, as the tokenizers library has it by default."""
        whole = data.tobytes()
        if not self.marks.search(whole):
            return self.encode(data, offsets)
        cuts, begins, tokens = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            begins.append(len(cuts))
            cuts.append(a)
            for m in self.marks.finditer(whole, a, b):
                tokens.append((len(cuts), self.added[m[0]]))
                cuts += [m.start(), m.end()]
        begins.append(len(cuts))
        ids, at = self.encode(data, np.append(cuts, offsets[-1]).astype(np.int64))
        ids, kept = ids.copy(), np.ones(len(ids), bool)
        for k, token in tokens:
            ids[at[k]] = token
            kept[at[k] + 1 : at[k + 1]] = False
        return ids[kept], np.concatenate([[0], np.cumsum(kept)])[at[begins]]


def encoder(path: str) -> Encoder:
    held = C._WORKER.get(("encoder", path))
    if held is None:
        held = C._WORKER["encoder", path] = Encoder(path)
    return held
