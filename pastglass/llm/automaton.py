"""Byte-pair encoding as a deterministic automaton over tokens.

A state says which tokens may follow. All words start from one state in which every byte may follow every byte. Each
merge (u, v) -> w, in order of rank, puts in one gadget: the state after u is copied without its arc v, all arcs u now
lead to the copy, every state with an arc u gets an arc w, and w leads where v led. The correct tokenization of a word
is then its only path. States share their past: a state is its last token, whose own removed arcs are found by (token,
follower) and whose inherited ones are those of its right part from before it was made; likewise a state has the arc w
if it had the arc u when w was made. So the table is one entry for each merge, and a transition is a few look-ups.
"""

from __future__ import annotations

import base64
import json
from pathlib import Path

import numpy as np

#: Splits a text into words before the merges; a fixed value of the public byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = 1 << 30
#: Words kept with their ids in each worker, and the longest word kept; neither changes a result.
KEPT_WORDS, KEPT_BYTES = 200_000, 64


def printable_bytes() -> dict[str, int]:
    """Character -> byte of the printable alphabet in which byte-level vocabularies are written.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, for the characters from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[int, int, int]]]:
    """(token bytes -> id, merges (left, right, made) in order of rank) of a .json or a .tiktoken file.

    A rank file holds no merges; they are found from the ranks, each token being the last merge of its own bytes.
    """
    if path.endswith(".json"):
        model, letters = json.loads(Path(path).read_text(encoding="utf-8"))["model"], printable_bytes()
        spelled = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        merges = []
        for m in model["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            merges.append((model["vocab"][left], model["vocab"][right], model["vocab"][left + right]))
        special = {m[i] for m in merges for i in range(3)} | {i for t, i in model["vocab"].items() if len(spelled.get(t, b"  ")) == 1}
        return {b: model["vocab"][t] for t, b in spelled.items() if model["vocab"][t] in special}, merges
    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: (r if (r := ranks.get(parts[i] + parts[i + 1], NO_RANK)) < rank else NO_RANK, i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((ranks[parts[0]], ranks[parts[1]], rank))
    return ranks, merges


def compile_tables(path: str) -> dict[str, np.ndarray]:
    """The automaton of a vocabulary file as plain arrays, bounded by the vocabulary (about 6 MB for 50,000 tokens)."""
    vocabulary, merges = read_vocabulary(path)
    size = max(vocabulary.values()) + 1
    left, right, made = np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    gadgets: dict[int, int] = {}
    probe = Automaton.__new__(Automaton)
    probe.left, probe.right, probe.made, probe.gadgets, probe.memo = left.tolist(), right.tolist(), made.tolist(), gadgets, {}
    single = {i for token, i in vocabulary.items() if len(token) == 1}
    for rank, (u, v, w) in enumerate(merges):
        there = all(t in single or probe.made[t] >= 0 for t in (u, v))
        if not there or not probe.fits(u, v):  # an arc that the merge needs doesn't exist, or no longer: it never happens
            continue
        gadgets[u << 32 | v] = rank
        if probe.made[w] < 0:
            probe.left[w], probe.right[w], probe.made[w] = u, v, rank
    ends = [-1]
    goto: dict[int, int] = {}
    for token, i in vocabulary.items():
        if i not in single and probe.made[i] < 0:  # no merge makes it, so no arc has its label
            continue
        at = 0
        for byte in token:
            step = goto.get(at << 8 | byte)
            if step is None:
                step = goto[at << 8 | byte] = len(ends)
                ends.append(-1)
            at = step
        ends[at] = i
    keys, nodes = np.fromiter(goto.keys(), np.int64, len(goto)), np.fromiter(goto.values(), np.int32, len(goto))
    spelled = [b""] * size
    for token, i in vocabulary.items():
        spelled[i] = token
    return {
        "left": np.array(probe.left, np.int32), "right": np.array(probe.right, np.int32), "made": np.array(probe.made, np.int32),
        "gadget_keys": np.fromiter(gadgets.keys(), np.int64, len(gadgets)), "gadget_ranks": np.fromiter(gadgets.values(), np.int32, len(gadgets)),
        "goto_keys": keys, "goto_nodes": nodes, "ends": np.array(ends, np.int32),
        "bytes": np.frombuffer(b"".join(spelled), np.uint8), "lengths": np.array([len(b) for b in spelled], np.int32),
    }


class Automaton:
    """Table-driven encoder and decoder over compiled tables."""

    def __init__(self, tables: dict[str, np.ndarray]) -> None:
        import regex

        self.left, self.right, self.made, self.ends = (tables[k].tolist() for k in ("left", "right", "made", "ends"))
        self.gadgets = dict(zip(tables["gadget_keys"].tolist(), tables["gadget_ranks"].tolist()))
        self.goto = dict(zip(tables["goto_keys"].tolist(), tables["goto_nodes"].tolist()))
        raw, stops = tables["bytes"].tobytes(), np.cumsum(tables["lengths"]).tolist()
        self.labels = [raw[a:b] for a, b in zip([0, *stops], stops)]
        self.memo: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall

    def fits(self, t: int, x: int) -> bool:
        """Whether the state after token t has an arc x."""
        made, gadgets = self.made, self.gadgets
        z, upto = t, NO_RANK
        while True:
            y, until = x, NO_RANK
            while True:
                rank = gadgets.get(z << 32 | y)
                # A merge of a token with itself takes the arc away before it looks which states have it: hence <=.
                if rank is not None and rank < upto and rank <= until:
                    return False
                if made[y] < 0:
                    break
                until = min(until, made[y])
                y = self.left[y]
            if made[z] < 0:
                return True
            upto = min(upto, made[z])
            z = self.right[z]

    def word(self, text: bytes) -> list[int]:
        """The ids of one word: the only path of its bytes."""
        goto, ends, memo = self.goto, self.ends, self.memo
        n = len(text)
        last = [-1] * (n + 1)
        for s in range(n):
            before, node = last[s], 0
            if s and before < 0:
                continue
            for e in range(s, n):
                node = goto.get(node << 8 | text[e])
                if node is None:
                    break
                t = ends[node]
                if t >= 0 and last[e + 1] < 0:
                    if s:
                        pair = before << 32 | t
                        fit = memo.get(pair)
                        if fit is None:
                            fit = memo[pair] = self.fits(before, t)
                            if len(memo) > 2_000_000:
                                memo.clear()
                    else:
                        fit = True
                    if fit:
                        last[e + 1] = t
        out, at, labels = [], n, self.labels
        while at:
            out.append(last[at])
            at -= len(labels[last[at]])
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for an empty or null text."""
        ids: list[int] = []
        if not text:
            return ids
        words = self.words
        for w in self.split(text):
            got = words.get(w)
            if got is None:
                raw = w.encode("utf-8", "surrogatepass")
                got = tuple(self.word(raw))
                if len(raw) <= KEPT_BYTES:
                    if len(words) >= KEPT_WORDS:
                        words.clear()
                    words[w] = got
            ids += got
        return ids

    def count(self, text: str | None) -> int:
        """How many ids a text has."""
        if not text:
            return 0
        words, n = self.words, 0
        for w in self.split(text):
            got = words.get(w)
            n += len(got) if got is not None else len(self.encode(w))
        return n

    def decode(self, ids: list[int] | None) -> str:
        """The text of the arc labels of a path; null or no ids give the empty text."""
        return b"".join(self.labels[i] for i in ids or []).decode("utf-8", "replace")
