"""Byte-level BPE: a minimal acyclic transducer holds the frequent words with their ids; other words are merged exactly.

The corpus' most frequent words are counted over all texts, merged once, and compiled (together with the vocabulary's own
whole words) into an automaton that shares prefixes and suffixes. Each transition carries how many words precede it, so
that the sum along a word's path is the word's number, and ids are found by that number. The automaton is a flat file
that each Python worker maps into memory.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, table

#: How byte-level BPE splits text, as the vocabulary's publishers give it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(PATTERN)
#: A space beside another white space character. Without one, what stands after a single space is split apart from the rest.
RUN = re.compile(r"\s | \s")
#: Words of more characters are merged each time they occur; the ids of shorter ones are kept, of up to 2 * CACHE in a worker.
LONG, CACHE = 96, 400_000
PIECES = 1 << 16
#: Words that are merged side by side.
SIDE = 1 << 12
#: A pair of ids, and a merge's rank and new id, are held in one integer.
SHIFT, MASK, NEVER = 24, (1 << 24) - 1, 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file, by rule: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """A minimal acyclic automaton over byte strings, with the number of each accepted string among them in sorted order."""

    NAMES = ("keys", "target", "skip", "final", "offsets", "ids")

    def __init__(self, entries: dict[bytes, list[int]]) -> None:
        states: dict[tuple, int] = {}
        counts: list[int] = []

        def freeze(depth: int) -> int:
            """Closes the path's nodes below depth, each by an equal state if there is one."""
            while len(path) > depth:
                final, labels, targets = path.pop()
                at = states.setdefault((final, tuple(labels), tuple(targets)), len(states))
                if at == len(counts):
                    counts.append(final + sum(counts[t] for t in targets))
                if path:
                    path[-1][2][-1] = at
            return at

        path: list[list] = [[False, [], []]]
        before, words = b"", sorted(entries)
        for w in words:
            same = len(os.path.commonprefix([before, w]))
            if same + 1 < len(path):
                freeze(same + 1)
            for b in w[same:]:
                path[-1][1].append(b)
                path[-1][2].append(-1)
                path.append([False, [], []])
            path[-1][0] = True
            before = w
        root = freeze(0)
        keys, target, skip, final = [], [], [], np.zeros(len(states), np.uint8)
        for (is_final, labels, targets), s in states.items():
            final[s], passed = is_final, int(is_final)
            for b, t in zip(labels, targets):
                keys.append(s << 8 | b)
                target.append(t)
                skip.append(passed)
                passed += counts[t]
        order = np.argsort(keys) if keys else np.zeros(0, np.int64)
        ids = [entries[w] for w in words]
        self.root = root
        self.keys, self.target, self.skip = np.array(keys, np.int64)[order], np.array(target, np.int32)[order], np.array(skip, np.int32)[order]
        self.final, self.offsets = final, np.cumsum([0, *map(len, ids)]).astype(np.int32)
        self.ids = np.fromiter(chain.from_iterable(ids), np.int32)

    def __getstate__(self) -> dict:
        """One flat block of bytes, and where each array stands in it."""
        parts, at, places = [], 0, {}
        for n in self.NAMES:
            a = np.ascontiguousarray(getattr(self, n))
            places[n] = (at, a.dtype.str, len(a))
            parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
            at += a.nbytes + -a.nbytes % 8
        return {"root": self.root, "places": places, "block": b"".join(parts)}

    def __setstate__(self, state: dict) -> None:
        self.root = state["root"]
        with tempfile.NamedTemporaryFile() as f:  # its name goes at once; the mapping keeps it
            f.write(state["block"])
            f.flush()
            block = np.memmap(f.name, np.uint8, "r").view(np.ndarray)
        for n, (at, kind, size) in state["places"].items():
            setattr(self, n, block[at : at + size * np.dtype(kind).itemsize].view(kind))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that aren't accepted; all words walk the automaton together."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words) + b"\0", np.uint8).astype(np.int64)
        live, state, number = np.arange(n), np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        depth = 0
        while len(live):
            ends = lengths[live] == depth
            done = ends & (self.final[state] != 0)
            out[live[done]] = number[done]
            live, state, number = live[~ends], state[~ends], number[~ends]
            key = state << 8 | flat[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at, number = live[ok], at[ok], number[ok]
            state, number = self.target[at].astype(np.int64), number + self.skip[at]
            depth += 1
        return out

    def outputs(self, number: int) -> list[int]:
        return self.ids[self.offsets[number] : self.offsets[number + 1]].tolist()


class Codec:
    """Encodes and decodes by the vocabulary file at path (a JSON file of the tokenizers library: byte-level BPE, split by PATTERN)."""

    def __init__(self, path: str, frequent: list[str] = ()) -> None:
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        letters = byte_letters()
        vocabulary = read["model"]["vocab"]
        raw = {t: bytes(letters[c] for c in t) for t in vocabulary}
        self.added = {a["content"]: a["id"] for a in read["added_tokens"]}
        self.token = [b""] * (max([*vocabulary.values(), *self.added.values()]) + 1)
        for t, i in vocabulary.items():
            self.token[i] = raw[t]
        for t, i in self.added.items():
            self.token[i] = t.encode()
        by_bytes = {b: vocabulary[t] for t, b in raw.items()}
        self.single = [by_bytes.get(bytes([b]), -1) for b in range(256)]
        self.merge = {}
        for rank, pair in enumerate(read["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge.setdefault(vocabulary[a] << SHIFT | vocabulary[b], (rank + 1) << SHIFT | vocabulary[a + b])
        self.pairs = np.array(sorted(self.merge), np.int64)
        self.merges = np.array([self.merge[k] for k in self.pairs.tolist()], np.int64)
        self.bytes_ids = np.array(self.single, np.int64)
        self.first = np.array([[self.merge.get(a << SHIFT | b, NEVER) if a >= 0 and b >= 0 else NEVER for b in self.single] for a in self.single], np.int64)
        entries = {}
        for word in chain(raw.values(), (w.encode() for w in frequent)):
            if len(word) <= LONG and word not in entries:
                try:
                    whole = SPLIT.fullmatch(word.decode()) is not None
                except UnicodeDecodeError:
                    whole = False
                if whole:
                    entries[word] = self.merged(word)
        self.lexicon = Transducer(entries)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
        self.sizes = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.block = np.frombuffer(b"".join(self.token), np.uint8)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def merged(self, word: bytes) -> list[int]:
        """Merges the lowest-ranked neighbouring pair, leftmost first, until none is left."""
        ids = [self.single[b] for b in word]
        if len(ids) > LONG:
            return self.merged_long(ids)
        get = self.merge.get
        found = [get(a << SHIFT | b, NEVER) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != NEVER:
            i = found.index(best)
            ids[i : i + 2] = [best & MASK]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << SHIFT | ids[i], NEVER)
            if i < len(found):
                found[i] = get(ids[i] << SHIFT | ids[i + 1], NEVER)
        return ids

    def merged_long(self, ids: list[int]) -> list[int]:
        """As merged(), by a heap of pairs over a linked list."""
        n, get = len(ids), self.merge.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << SHIFT | ids[i + 1]))]
        heapify(heap)
        while heap:
            m, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = m & MASK, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (m := get(ids[left] << SHIFT | ids[right])):
                    heappush(heap, (m, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge of each pair of ids, NEVER where there is none."""
        key = a << SHIFT | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merges[at], NEVER)

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as merged() finds them: words of like length take their best merges side by side, one a turn."""
        out: list[bytes] = [b""] * len(words)
        if not len(self.pairs):
            return [np.array(self.merged(w), "<u4").tobytes() for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for lo in range(0, len(words), SIDE):
            rows = order[lo : lo + SIDE]
            size = lengths[rows].copy()
            wide = max(int(size[-1]), 2)
            raw = np.frombuffer(b"".join([words[i].ljust(wide, b"\0") for i in rows.tolist()]), np.uint8).reshape(len(rows), wide)
            ids = self.bytes_ids[raw]
            best = self.first[raw[:, :-1], raw[:, 1:]]
            best[np.arange(wide - 1) >= (size - 1)[:, None]] = NEVER
            live, column, done = np.arange(len(rows)), np.arange(wide), np.zeros_like(ids)
            while True:
                p = best.argmin(1)
                which = np.arange(len(live))
                merge = best[which, p]
                going = merge != NEVER
                if not going.all():
                    done[live[~going]] = ids[~going]
                    live, ids, best, p, merge = live[going], ids[going], best[going], p[going], merge[going]
                    which = which[: len(live)]
                if not len(live):
                    break
                after = column > p[:, None]
                ids = np.take_along_axis(ids, np.minimum(column + after, wide - 1), 1)
                ids[which, p] = merge & MASK
                # The pair itself goes; those on both sides of the new id are looked up.
                best = np.take_along_axis(best, np.minimum(column[:-1] + (column[:-1] >= p[:, None]), wide - 2), 1)
                size[live] -= 1
                best[:, -1] = NEVER
                for at, has in ((p - 1, p > 0), (p, p < size[live] - 1)):
                    w = which[has]
                    best[w, at[has]] = self.lookup(ids[w, at[has]], ids[w, at[has] + 1])
                w = which[p >= size[live] - 1]
                best[w, np.minimum(p[w], wide - 2)] = NEVER
            flat = done[column < size[:, None]].astype("<u4").tobytes()
            stops = np.cumsum(size) * 4
            for i, stop, n in zip(rows.tolist(), stops.tolist(), (size * 4).tolist()):
                out[i] = flat[stop - n : stop]
        return out

    def ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word by the transducer, those that it doesn't accept merged."""
        numbers = self.lexicon.numbers(words)
        blob, offsets = self.lexicon.ids.astype("<u4").tobytes(), self.lexicon.offsets * 4
        out: list = [None] * len(words)
        found = np.flatnonzero(numbers >= 0)
        for i, a, b in zip(found.tolist(), offsets[numbers[found]].tolist(), offsets[numbers[found] + 1].tolist()):
            out[i] = blob[a:b]
        rare = np.flatnonzero(numbers < 0).tolist()
        short = [i for i in rare if len(words[i]) <= LONG]
        for i, ids in zip(short, self.merged_all([words[i] for i in short])):
            out[i] = ids
        for i in rare:
            if out[i] is None:
                out[i] = np.array(self.merged(words[i]), "<u4").tobytes()
        return out

    def learn(self, chunks: set[str], lead: str) -> dict[str, bytes]:
        """Ids of lead + chunk for each chunk."""
        # Letters alone are one word, with the space before them; what else there is is split by the pattern.
        letters = [c for c in chunks if c.isalpha()]
        others = [c for c in chunks if not c.isalpha()]
        split = [SPLIT.findall(lead + c) for c in others]
        rest = list({w for ws in split for w in ws})
        ids = self.ids_of_words([(lead + c).encode() for c in letters] + [w.encode() for w in rest])
        known = dict(zip(letters, ids))
        of = dict(zip(rest, ids[len(letters) :]))
        known.update(zip(others, (of[ws[0]] if len(ws) == 1 else b"".join(map(of.__getitem__, ws)) for ws in split)))
        return known

    def know(self, chunks: set[str], lead: str) -> dict[str, bytes]:
        """Ids of all chunks, each with lead before it, and of others. Two generations of known chunks are kept."""
        new, old = self.known.setdefault(lead, ({}, {}))
        missing = chunks.difference(new)
        if old and missing:
            again = missing.intersection(old)
            new.update(zip(again, map(old.__getitem__, again)))
            missing -= again
        large = {c for c in missing if len(c) > LONG}
        new |= self.learn(missing - large, lead)
        if len(new) > CACHE:
            self.known[lead] = ({}, new)
        return new | self.learn(large, lead) if large else new

    def ids_of(self, chunks: list[str], lead: str) -> bytes:
        """Ids of the chunks, each with lead before it."""
        try:
            return b"".join(map(self.known[lead][0].__getitem__, chunks))
        except KeyError:
            return b"".join(map(self.know(set(chunks), lead).__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Ids of text as unsigned 32-bit little-endian integers."""
        out = []
        for part in self.cut.split(text) if self.cut and self.cut.search(text) else [text]:
            if part in self.added:
                out.append(np.array([self.added[part]], "<u4").tobytes())
            elif not RUN.search(part):
                first, *chunks = part.split(" ")
                out += [self.ids_of([first], ""), self.ids_of(chunks, " ")]
            else:
                found = (m[0] for m in SPLIT.finditer(part))
                while pieces := list(islice(found, PIECES)):
                    out.append(self.ids_of(pieces, ""))
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """As encode() for each; what is new to the worker is learnt at once."""
        split, pieces = [t.split(" ") if not RUN.search(t) else None for t in texts], set()
        later: set[str] = set()
        for t, chunks in zip(texts, split):
            if chunks is None:
                if len(t) < PIECES:
                    pieces.update(SPLIT.findall(t))
            else:
                pieces.add(chunks[0])
                later.update(chunks)
        ahead, whole = self.know(later, " "), self.know(pieces, "")
        out = []
        for t, chunks in zip(texts, split):
            if chunks is None or (self.cut and self.cut.search(t)):
                out.append(self.encode(t))
            else:
                first = whole[chunks[0]]
                del chunks[0]
                out.append(first + b"".join(map(ahead.__getitem__, chunks)))
        return out

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0]

    def decode_all(self, coded: list[bytes]) -> list[str]:
        """The ids' bytes are taken from the vocabulary for all texts at once; what is no UTF-8 is replaced."""
        ids = np.frombuffer(b"".join(coded), "<u4")
        sizes = self.sizes[ids]
        stops = np.cumsum(sizes)
        place = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(self.starts[ids] - (stops - sizes), sizes)
        flat = self.block[place].tobytes()
        cuts = np.cumsum([0, *[len(c) // 4 for c in coded]])
        ends = np.concatenate([[0], stops])[cuts].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def frequent_words(docs: DataFrame, text: str = "text", n: int = 16_384) -> list[str]:
    """The most frequent words of all texts (letters with the space before them), at most n: those of the highest counts, all words of a count or none."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(r"\x20?\p{L}+"), F.lit(0))).alias("w"))
    counts = checkpoint(words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1"))
    above = counts.groupBy("n").agg(F.count("*").alias("words"))
    higher = F.sum("words").over(Window.orderBy(F.desc("n")))
    # The few distinct counts come to one task; the words, at most n, only then to the driver.
    least = above.withColumn("higher", higher).where(F.col("higher") <= n).agg(F.min("n")).first()[0]
    return sorted(r.w for r in counts.where(F.col("n") >= least).select("w").collect()) if least else []


def encode(docs: DataFrame, keep: list[str], path: str, text: str = "text", lexicon: int = 16_384) -> DataFrame:
    """The columns keep, ids (binary: unsigned 32-bit little-endian ids of the whole text) and decoded (the ids' text).

    Strings of added tokens in a text become those tokens. A null or empty text has no ids and decodes to the empty text.
    Repeated rows are encoded alike. path: the vocabulary file, read on the driver; lexicon: words that frequent_words() gives.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(path, frequent_words(docs, text, lexicon)))

    def make():
        codec = shared.value

        def work(texts):
            coded = codec.encode_all([t.decode() if t else "" for t in texts])
            return coded, codec.decode_all(coded)

        return work

    return map_texts(docs, keep, text, "ids binary, decoded string", make)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, and of encode()'s ids and decoded: n_tokens, ids_sha256, decoded_sha256."""
    return coded.select("doc_id", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], default_path()))
