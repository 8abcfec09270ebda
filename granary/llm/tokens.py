"""Token counts of a byte-level BPE tokenizer by compiled finite-state machines.

The tokenizer's file is compiled once. Its splitting rule becomes a deterministic transducer over eight character
classes (letters, numbers, other, the white space and apostrophe cases that look ahead), whose transitions say whether
they emit a new piece. A chunk of text is cut into blocks; each block is reduced to its state map (exit state for every
entry state), the maps are composed by a parallel prefix scan, and a second pass reads off the emissions from the entry
states found. The bytes of a piece go through a second transducer (`Machine`), whose transitions carry the change of the
number of tokens: no merge is replayed and nothing is looked up but transitions. It is compiled lazily, transition by transition; all
distinct pieces of a chunk move through it together, and their counts are remembered for later chunks.

Behaviour at the edges: a null text is empty and has no tokens; the added special token counts as one wherever it stands;
texts of any length are counted whole; repeated rows get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import repeats as R

L, N, O, A2, A3, SPACE, BREAK, BLANK = range(8)  # classes; A2, A3: an apostrophe that begins a contraction of 2 or 3
FRESH, IN_L, IN_N, IN_O, PREFIX, IN_BLANK, LAST, TWO = range(8)  # states
FIRST = 8  # added to the class of a text's first character, where every state is as FRESH
BLOCK, LONG, STATES, CACHE, CHUNK = 64, 128, 1 << 18, 1 << 20, 4 << 20


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by class * 8 + state. The rule is the public one of byte-level BPE:

    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space not before others|white space
    """
    step, emits = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    joins = {L: (IN_L, PREFIX), N: (IN_N, PREFIX), O: (IN_O, PREFIX), A2: (IN_O, PREFIX), A3: (IN_O, PREFIX), SPACE: (), BREAK: (), BLANK: (IN_BLANK,)}
    state = {L: IN_L, N: IN_N, O: IN_O, A2: LAST, A3: TWO, SPACE: PREFIX, BREAK: FRESH, BLANK: IN_BLANK}
    for c in range(8):
        for s in range(8):
            step[c, s] = state[c]
            if s in joins[c]:
                emits[c, s] = False
                step[c, s] = IN_O if c in (A2, A3) else state[c]
        step[c, TWO], step[c, LAST] = LAST, FRESH
        emits[c, [TWO, LAST]] = False
    for c in range(8):
        step[FIRST + c] = step[c, FRESH]
    return step.reshape(-1), emits.reshape(-1)


def character_classes() -> np.ndarray:
    """Letter, number, other or white space (as BLANK) of every code point."""
    out = np.full(0x110000, O, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", L), (r"\p{N}+", N), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            out[a : b + 1] = kind
    return out


class Machine:
    """The transducer of pieces: it reads bytes, and each transition carries by how much the number of tokens changes.

    After any prefix of a piece one token is the last of its tokens. Only one token that ends there can follow the last
    token of what is before it: one that no merge across the seam would have broken up (`follows`). So a state needs the
    longest suffix that some token begins with, and for each place in it the last token and the number of tokens as seen
    from here. That is a finite set for a vocabulary; states and transitions are compiled when a text first asks for them.
    """

    def __init__(self, model: dict) -> None:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in printable)}
        vocab = model["vocab"]
        self.token: dict[bytes, int] = {bytes([b]): vocab[shown[b]] for b in range(256)}
        self.born: dict[int, int] = {t: -1 for t in self.token.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.ranks: dict[tuple[int, int], int] = {}
        text = {t: b for b, t in self.token.items()}
        for rank, m in enumerate(model["merges"]):
            left, right = (vocab[x] for x in (m if isinstance(m, list) else m.split(" ")))
            if left not in text or right not in text:
                raise ValueError("a merge comes before the merges that make its parts")
            if (left, right) in self.ranks:
                continue
            self.ranks[left, right] = rank
            whole = text[left] + text[right]
            made = vocab["".join(shown[b] for b in whole)]
            if made not in text:  # a token's first way of being made is the one that happens
                text[made], self.parts[made], self.born[made] = whole, (left, right), rank
                self.token[whole] = made
        self.begins = {b[:i] for b in self.token for i in range(len(b))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.alone = {t: t not in self.parts or self.follows(*self.parts[t], self.born[t]) for t in text}
        self.reset()

    def reset(self) -> None:
        self.fits.clear()
        self.states: list[tuple[bytes, tuple, tuple]] = [(b"", (None,), (0,))]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.keys, self.after, self.change = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank at which it goes into a larger one) along the left (0) or right (1) edge of a token."""
        out, gone = [(token, 1 << 60)], 1 << 60
        while token in self.parts:
            gone = self.born[token]
            token = self.parts[token][side]
            out.append((token, gone))
        return out

    def follows(self, left: int, right: int, before: int = 1 << 60) -> bool:
        """Whether the two tokens stay apart: no pair at the seam merges (before rank `before`) while both of it are there.

        Of equal ranks the pair further left merges first.
        """
        if before == 1 << 60 and (left, right) in self.fits:
            return self.fits[left, right]
        edges, apart = self._edge(right, 0), True
        for x, x_gone in self._edge(left, 1):
            for y, y_gone in edges:
                rank = self.ranks.get((x, y))
                if rank is not None and rank < before and rank < x_gone and rank <= y_gone:
                    apart = False
        if before == 1 << 60:
            self.fits[left, right] = apart
        return apart

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the number of tokens)."""
        key = state << 8 | byte
        if key in self.moves:
            return self.moves[key]
        suffix, lasts, counts = self.states[state]
        suffix += bytes([byte])
        for begin in range(len(suffix)):
            token = self.token.get(suffix[begin:])
            if token is not None and self.alone[token] and (lasts[begin] is None or self.follows(lasts[begin], token)):
                break
        change = counts[begin] + 1
        lasts, counts = (*lasts, token), (*counts, change)
        drop = next(i for i in range(len(suffix) + 1) if suffix[i:] in self.begins)
        new = suffix[drop:], lasts[drop:], tuple(c - change for c in counts[drop:])
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        self.moves[key] = number, change
        return number, change

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Where the transitions stand in the compiled arrays; those not there yet are compiled first."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.unique(keys[self.keys[at] != keys]) if len(self.keys) else np.unique(keys)
        if not len(new):
            return at
        made = np.array([self.move(k >> 8, k & 255) for k in new.tolist()], np.int64).reshape(-1, 2)
        place = np.searchsorted(self.keys, new)
        self.keys, self.after, self.change = (np.insert(old, place, add) for old, add in ((self.keys, new), (self.after, made[:, 0]), (self.change, made[:, 1])))
        return np.searchsorted(self.keys, keys)

    def counts(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece raw[begin:end]: all pieces move on together, byte by byte, long ones to their end one by one."""
        if len(self.states) > STATES:  # bounds memory; what is asked for again is compiled again
            self.reset()
        out, state = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        live = np.flatnonzero(ends > begins)
        for k in range(LONG):
            if not len(live):
                return out
            at = self._find(state[live] << 8 | raw[begins[live] + k].astype(np.int64))
            state[live], out[live] = self.after[at], out[live] + self.change[at]
            live = live[begins[live] + k + 1 < ends[live]]
        for i in live.tolist():
            here, total = int(state[i]), int(out[i])
            for byte in raw[begins[i] + LONG : ends[i]].tolist():
                here, change = self.move(here, byte)
                total += change
            out[i] = total
        return out


class Compiled:
    """A tokenizer file as tables: classes, transducer, merges and the special strings."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer and prefix space is asked for")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.classes, self.machine = character_classes(), Machine(spec["model"])
        self.step, self.emits = transducer()
        self.known: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def pieces(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pieces begin, in bytes, for texts without special strings."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return lead
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(lead, bounds)] = True
        kind = self.classes[points]
        follows = np.append(kind[1:], BLANK)
        follows[first[1:]] = BLANK
        blank = kind == BLANK
        kind[blank & (follows != BLANK)] = BREAK
        kind[(points == 32) & (kind == BREAK)] = SPACE
        quote = np.flatnonzero(points[: n - 1] == 39)
        if len(quote):
            one = points[quote + 1]
            two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
            apart, later = first[quote + 1], first[np.minimum(quote + 2, n)]
            short = np.isin(one, [ord(c) for c in "stmd"]) & ~apart
            long = ~apart & ~later & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            kind[quote[short]], kind[quote[long]] = A2, A3
        kind[first[:n]] += FIRST
        blocks = -(-n // BLOCK)
        padded = np.zeros(blocks * BLOCK, np.uint8)
        padded[:n] = kind
        by_place = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.int16) * 8
        maps = np.repeat(np.arange(8, dtype=np.uint8)[None], blocks, axis=0)
        for k in range(BLOCK):
            maps = self.step[by_place[k][:, None] + maps]
        shift = 1
        while shift < blocks:  # composition is associative: each round doubles the blocks behind a map
            maps = np.concatenate([maps[:shift], np.take_along_axis(maps[shift:], maps[:-shift], axis=1)])
            shift *= 2
        state = np.append(np.uint8(FRESH), maps[:-1, FRESH])
        emitted = np.zeros((BLOCK, blocks), bool)
        for k in range(BLOCK):
            at = by_place[k] + state
            emitted[k] = self.emits[at]
            state = self.step[at]
        return lead[np.flatnonzero(emitted.T.reshape(-1)[:n])]

    def tokens(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        extra = np.zeros(len(bounds) - 1, np.int64)
        cuts, gone = [], []
        whole = raw.tobytes()
        for s in self.special:
            at = whole.find(s)
            while at >= 0:
                text = int(np.searchsorted(bounds, at, "right")) - 1
                if at + len(s) <= bounds[text + 1]:
                    extra[text] += 1
                    cuts += [at, at + len(s)]
                    gone.append(at)
                    at += len(s) - 1
                at = whole.find(s, at + 1)
        parts = np.unique(np.concatenate([bounds, np.array(cuts, np.int64)]))
        begins = self.pieces(raw, parts)
        if not len(begins):
            return extra
        ends = np.append(begins[1:], len(raw))
        if gone:
            part = np.searchsorted(parts, begins, "right") - 1
            kept = ~np.isin(parts[part], gone)
            begins, ends = begins[kept], ends[kept]
        keys = R.run_symbols(raw, begins, ends)
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        known, counts = self.known
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        found = known[at] == keys if len(known) else np.zeros(len(keys), bool)
        each = np.zeros(len(keys), np.int64)
        each[found] = counts[at[found]]
        new = np.flatnonzero(~found)
        each[new] = self.machine.counts(raw, begins[first[new]], ends[first[new]])
        if len(known) + len(new) > CACHE:
            self.known = (keys, each)
        else:
            merged, counted = np.concatenate([known, keys[new]]), np.concatenate([counts, each[new]])
            order = np.argsort(merged, kind="stable")
            self.known = (merged[order], counted[order])
        text = np.searchsorted(bounds, begins, "right") - 1
        return extra + np.bincount(text, weights=each[which], minlength=len(extra)).astype(np.int64)


def count(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens and over_limit. `tokenizer` is the path of the file, on the driver."""
    with open(tokenizer, "rb") as f:
        file = zlib.compress(f.read())  # about 1 MB, sent with the task function; each process compiles it once
    name = ("tokenizer", hashlib.sha256(file).hexdigest())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = R.process_cache()
        if name not in kept:
            kept[name] = Compiled(zlib.decompress(file))
        machine = kept[name]  # transitions and pieces that earlier tasks of this process compiled are there
        for batch in batches:
            raw, bounds = R.texts_of(batch.column("text"))
            parts = [machine.tokens(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in R.steps(bounds, CHUNK)]
            n = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), n], names=["doc_id", "n_bytes", "n_tokens"])

    found = R.small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
