"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus are encoded once and compiled into a shared-suffix automaton whose arcs carry number
outputs; their sum along a word's path is its place in a table of ids. The file is written to the shared folder and
memory-mapped by the workers, which look up every distinct word of a group of texts in it. Words that it lacks are merged
exactly, by the ranks of the vocabulary's merges, many side by side.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import KEPT, discard, map_arrow, shared_dir, stored
from .token_frames import byte_chars, open_fs

#: Words of the lexicon, a bound on what the driver compiles; only speed depends on it.
LEXICON = 65_536
LONGEST = 48
#: Bytes of texts that are encoded together, and rows that are counted together.
GROUP, ROWS = 8_000_000, 2048


# --- the automaton -------------------------------------------------------------------------------------------------


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words; arc outputs add up to a word's index in ``words``.

    States are minimised as soon as no later word can pass them (incremental construction from sorted input).
    """
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []  # of finished states: (byte, target)
    final: list[bool] = []
    path: list[list] = [[[], False]]  # unfinished states along the last word: arcs and finality

    def freeze(state) -> int:
        key = (tuple(state[0]), state[1])
        if key not in register:
            register[key] = len(arcs)
            arcs.append(state[0])
            final.append(state[1])
        return register[key]

    last = b""
    for w in words:
        same = len(os.path.commonprefix([last, w]))
        while len(path) > same + 1:
            state = path.pop()
            path[-1][0].append((last[len(path) - 1], freeze(state)))
        for _ in w[same:]:
            path.append([[], False])
        path[-1][1] = True
        last = w
    while len(path) > 1:
        state = path.pop()
        path[-1][0].append((last[len(path) - 1], freeze(state)))
    root = freeze(path[0])
    below = np.zeros(len(arcs), np.int64)
    keys, targets, outputs = [], [], []
    for s, own in enumerate(arcs):  # targets come before their sources
        n = int(final[s])
        for byte, t in own:
            keys.append(s << 8 | byte)
            targets.append(t)
            outputs.append(n)
            n += int(below[t])
        below[s] = n
    return {"key": np.array(keys, np.int64), "target": np.array(targets, np.int32), "output": np.array(outputs, np.int32), "final": np.array(final, np.uint8), "root": np.array([root], np.int64)}


class Lexicon:
    """A memory-mapped automaton with its table of ids."""

    PARTS = (("key", np.int64), ("target", np.int32), ("output", np.int32), ("final", np.uint8), ("root", np.int64), ("offset", np.int64), ("ids", np.int32))

    def __init__(self, source: str | bytes) -> None:
        """``source``: the file's path, or its bytes where it cannot be mapped."""
        raw = np.memmap(source, np.uint8, "r") if isinstance(source, str) else np.frombuffer(source, np.uint8)
        sizes = raw[: 8 * len(self.PARTS)].view(np.int64).tolist()
        at = 8 * len(self.PARTS)
        for (name, kind), n in zip(self.PARTS, sizes):
            setattr(self, name, raw[at : at + n * np.dtype(kind).itemsize].view(kind).view(np.ndarray))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def pack(cls, words: list[bytes], ids: np.ndarray, offset: np.ndarray) -> bytes:
        parts = build_automaton(words) | {"offset": offset, "ids": ids}
        out = [np.array([len(parts[n]) for n, _ in cls.PARTS], np.int64).tobytes()]
        for name, kind in cls.PARTS:
            data = parts[name].astype(kind).tobytes()
            out.append(data + b"\0" * (-len(data) % 8))
        return b"".join(out)

    def find_all(self, words: pa.Array) -> np.ndarray:
        """Index of each word (of a large string array) in the lexicon, or -1; all words walk the automaton together, a byte at a time."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return out
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1]
        begin, size = offsets[:-1], np.diff(offsets)
        text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        live = np.flatnonzero(size > 0)
        state, total = np.full(n, int(self.root[0])), np.zeros(n, np.int64)
        k = 0
        while len(live):
            key = state[live] << 8 | text[begin[live] + k]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            live, at = live[ok], at[ok]
            state[live] = self.target[at]
            total[live] += self.output[at]
            k += 1
            ended = size[live] == k
            done = live[ended]
            done = done[self.final[state[done]] == 1]
            out[done] = total[done]
            live = live[~ended]
        return out

    def find(self, words: list[bytes]) -> np.ndarray:
        return self.find_all(pa.array(words, pa.large_binary()))


# --- words ---------------------------------------------------------------------------------------------------------


def ragged(offset: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the values, sizes) of the lists ``at`` of a list array with these offsets, one after another."""
    size = offset[at + 1] - offset[at]
    total = int(size.sum())
    return np.repeat(offset[at] - np.cumsum(size) + size, size) + np.arange(total), size


class Merges:
    """Exact byte-pair merges by rank, of many words at once."""

    NONE = 1 << 30
    #: Bytes up to which words are merged side by side, and words in one table.
    WIDE, ROWS = 64, 8192

    def __init__(self, vocab: dict[str, int], merges: list, end: str) -> None:
        chars = byte_chars()
        self.inside = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.of = {tuple(m): (r, int(self.made[r])) for r, m in enumerate(zip((key >> 17).tolist(), (key & 0x1FFFF).tolist()))}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 17 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.rank[at], self.NONE)

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the words, each of one byte at least."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        wide = int(np.searchsorted(size[order], self.WIDE, side="right"))
        parts: list[tuple] = []  # owners, sizes, ids
        for at in range(0, wide, self.ROWS):
            rows = order[at : min(at + self.ROWS, wide)]
            parts += [(rows[own], n, ids) for own, n, ids in self._table([words[i] for i in rows.tolist()], size[rows])]
        for i in order[wide:].tolist():
            ids = np.array(self.one(words[i]), np.int64)
            parts.append((np.array([i]), np.array([len(ids)]), ids))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        owner, count, ids = (np.concatenate(x) for x in zip(*parts))
        back = np.argsort(owner)
        place, count = ragged(np.concatenate(([0], np.cumsum(count))), back)
        return ids[place], np.concatenate(([0], np.cumsum(count)))

    def _table(self, words: list[bytes], size: np.ndarray) -> list[tuple]:
        """Of each row the pair of least rank, the first of equals, is merged, again and again; (rows, sizes, ids) of those that are done."""
        n, wide = len(words), int(size.max())
        cols = np.arange(wide)
        raw = np.zeros((n, wide), np.uint8)
        raw[cols < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        ids = np.where(cols < size[:, None], self.inside[raw], -1)
        ids[np.arange(n), size - 1] = self.final[raw[np.arange(n), size - 1]]
        out, live = [], np.arange(n)
        rank = self.ranks(ids[:, :-1], ids[:, 1:])
        while len(live):
            if rank.shape[1]:
                at = rank.argmin(1)
                least = rank[np.arange(len(live)), at]
                done = least == self.NONE
            else:
                done = np.ones(len(live), bool)
            if done.any():
                there = ids[done] >= 0
                out.append((live[done], there.sum(1), ids[done][there]))
                live, ids, rank = live[~done], ids[~done], rank[~done]
                if not len(live):
                    break
                at, least = at[~done], least[~done]
            own = np.arange(len(live))
            after = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[own, at] = self.made[least]
            ids = np.where(after, ids[:, 1:], ids[:, :-1])
            rank = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            for shift in (-1, 0):  # the pairs that the new token is in
                k = at + shift
                ok = (k >= 0) & (k < rank.shape[1])
                rank[own[ok], k[ok]] = self.ranks(ids[own[ok], k[ok]], ids[own[ok], k[ok] + 1])
        return out

    def one(self, word: bytes) -> list[int]:
        """A very long word: pairs wait in a heap by rank and place."""
        ids = [*self.inside[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.final[word[-1]])]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        of = self.of
        heap = [(of[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in of]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != pair[0] or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = of[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (p := (ids[a], ids[after[a]])) in of:
                    heapq.heappush(heap, (of[p][0], a, p))
        return [x for x in ids if x >= 0]


#: A word of Latin letters alone, with or without one mark behind it: all of it one piece, or two.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
#: White space to Python and Arrow but not to the library: such texts go to the library whole.
ODD = "[\x1c-\x1f]"


def base_words(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(what the lexicon knows each word by, the mark behind it: 1 for a full stop and 2 for a comma, whether it is letters): letters alone count in lower case."""
    letters = pc.match_substring_regex(words, LETTERS)
    base = pc.if_else(letters, pc.utf8_lower(pc.utf8_rtrim(words, ".,")), words)
    mark = pc.if_else(letters, pc.if_else(pc.ends_with(words, "."), 1, pc.if_else(pc.ends_with(words, ","), 2, 0)), 0)
    return base, mark.to_numpy(zero_copy_only=False), letters.to_numpy(zero_copy_only=False)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(offsets of the texts, the distinct words, the place of each text's words among them)."""
    lists = pc.utf8_split_whitespace(texts)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    at, names = coded.indices.to_numpy(), coded.dictionary
    blank = pc.index(names, pa.scalar("", names.type)).as_py()
    if blank >= 0:  # beside white space at either end of a text
        row = np.repeat(np.arange(len(size)), size)
        size = np.bincount(row[at != blank], minlength=len(size))
        at = at[at != blank]
    return np.concatenate(([0], np.cumsum(size))).astype(np.int64), names, at


class Codec:
    """Encodes and decodes like the tokenizers library does with the same file: the automaton first, merges for what it lacks."""

    def __init__(self, path: str, lexicon: Lexicon | None = None) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        added = {i: t.content for i, t in self.lib.get_added_tokens_decoder().items()}
        self.special = list(added.values())
        self.name = {i: t for t, i in model["vocab"].items()} | added
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.raw = {c: i for i, c in enumerate(byte_chars())}
        self.lexicon = lexicon
        ids = range(max(self.name) + 1)
        self.names = pa.array([self.name.get(i, "") for i in ids], pa.large_string())
        self.decimals = pa.array(map(str, ids), pa.large_string())
        self.marks = np.array([0, *(self.merges.one(c.encode())[0] for c in ".,")])

    def pieces(self, word: str) -> list[bytes]:
        """The pieces that the library cuts a word into, as bytes."""
        cut_ = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(word))
        return [bytes(map(self.raw.__getitem__, p)) for p, _ in cut_]

    def word_ids(self, words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of base words, by merging; ``letters``: those that are one piece."""
        pieces, owner = [], []
        for i, (w, whole) in enumerate(zip(words, letters.tolist())):
            own = [w.encode()] if whole else self.pieces(w)
            pieces += own
            owner += [i] * len(own)
        ids, offset = self.merges.many(pieces)
        size = np.bincount(np.array(owner, np.int64), np.diff(offset), len(words)).astype(np.int64) if pieces else np.zeros(len(words), np.int64)
        return ids, np.concatenate(([0], np.cumsum(size)))

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct words."""
        base, mark, letters = base_words(words)
        coded = base.dictionary_encode()
        names, at = coded.dictionary, coded.indices.to_numpy()
        one_piece = np.zeros(len(names), bool)
        one_piece[at[letters]] = True
        found = self.lexicon.find_all(names) if self.lexicon else np.full(len(names), -1)
        new = np.flatnonzero(found < 0)
        merged, off = self.word_ids(names.take(pa.array(new)).to_pylist(), one_piece[new])
        if self.lexicon is not None and len(new) < len(names):  # both sources of ids, one behind the other
            known = np.flatnonzero(found >= 0)
            place, size = ragged(self.lexicon.offset, found[known])
            values = np.concatenate([merged, self.lexicon.ids[place]])
            start, count = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            start[new], count[new] = off[:-1], np.diff(off)
            start[known], count[known] = len(merged) + np.cumsum(size) - size, size
        else:
            values, start, count = merged, off[:-1], np.diff(off)
        count, start = count[at], start[at]
        total = count + (mark > 0)
        offset = np.concatenate(([0], np.cumsum(total))).astype(np.int64)
        out = np.empty(int(offset[-1]), np.int64)
        out[offset[1:][mark > 0] - 1] = self.marks[mark[mark > 0]]
        to = np.repeat(offset[:-1] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        out[to] = values[np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
        return out, offset

    def encoded(self, texts: pa.Array):
        """(first row, ids, offsets of the rows) of groups of texts; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.binary_length(texts).to_numpy()
        at = 0
        while at < len(texts):
            end = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), GROUP, side="right")))
            yield at, *self._group(texts.slice(at, end - at))
            at = end

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(odd):
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            whole = [np.array(self.lib.encode(t, add_special_tokens=False).ids, np.int64) for t in texts.take(pa.array(odd)).to_pylist()]
            texts = pc.if_else(pa.array(mask), pa.scalar("", texts.type), texts)
        rows, words, at = split_words(texts)
        ids, offset = self.ids_of(words)
        place, size = ragged(offset, at)
        ends = np.concatenate(([0], np.cumsum(size)))[rows]
        flat = ids[place].astype(np.uint32)
        if len(odd):
            own = np.split(flat, ends[1:-1])
            for i, x in zip(odd.tolist(), whole):
                own[i] = x.astype(np.uint32)
            flat, ends = np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))
        return flat, ends

    def joined(self, ids: np.ndarray, ends: np.ndarray, tokens: bool) -> pa.Array:
        """For each row's ids, joined by spaces: the tokens (that is the decoded text), else the decimal ids."""
        values = (self.names if tokens else self.decimals).take(pa.array(ids))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values), pa.scalar(" ", pa.large_string()))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.encoded(pa.array([text], pa.large_string())) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False): unknown ids are passed over."""
        return " ".join(self.name[i] for i in ids if i in self.name)


# --- frames --------------------------------------------------------------------------------------------------------


def _count(batches):
    """Base words with their counts, put together over some groups of texts."""
    held, rows = [], 0

    def summed():
        t = pa.concat_tables(held).combine_chunks().group_by("word").aggregate([("n", "sum")])
        held.clear()
        yield from t.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches()

    for b in batches:
        texts = pc.fill_null(b.column(0).cast(pa.large_string()), "")
        for at in range(0, len(texts), ROWS):
            _, words, places = split_words(texts.slice(at, ROWS))
            if not len(words):
                continue
            base = base_words(words)[0]
            short = pc.less_equal(pc.binary_length(base), LONGEST)
            t = pa.table({"word": base.cast(pa.string()), "n": pa.array(np.bincount(places, minlength=len(words)), pa.int64())}).filter(short)
            held.append(t)
            rows += t.num_rows
            if rows > 600_000:
                yield from summed()
                rows = 0
    if held:
        yield from summed()


def compile_lexicon(docs: DataFrame, tokenizer: str, text: str = "text", size: int = LEXICON) -> str:
    """Counts the words of all documents, compiles the most frequent ones, ``size`` at most, and writes the file; its place.

    How often a word must stand is read from a histogram of the counts, so no task sorts words.
    """
    spark = docs.sparkSession
    counts = map_arrow(docs.select(F.col(text).cast("string").alias("text")), _count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted, at = stored(counts)
    band = F.when(F.col("n") < 256, F.col("n")).otherwise(F.floor(F.log2("n") * 64) - 256).cast("int")
    left, least = size, None
    for r in sorted(counted.groupBy(band.alias("band")).count().collect(), key=lambda r: -r["band"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["band"]
    found = [] if least is None else [r["word"] for r in counted.where(band >= least).select("word").collect()]
    discard(spark, at)
    codec = Codec(tokenizer)
    words = sorted(w.encode() for w in found if not re.search(ODD, w) and not any(x in w for x in codec.special))
    letters = re.compile("^[A-Za-zÀ-ÖØ-öø-ÿ]+$")
    ids, offset = codec.word_ids([w.decode() for w in words], np.array([letters.search(w.decode()) is not None for w in words], bool))
    data = Lexicon.pack(words, ids, offset)
    out = f"{shared_dir(spark)}/lexicon-{uuid.uuid4().hex}.fst"
    fs, path = open_fs(out)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)
    return out


@cache
def codec(tokenizer: str, lexicon: str) -> Codec:
    """A worker's codec; the lexicon is mapped where the worker sees it as a file, and read (a few MB) from any other store."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    fs, path = open_fs(lexicon)
    if fs.type_name == "local":
        return Codec(tokenizer, Lexicon(path))
    with fs.open_input_stream(path) as src:
        return Codec(tokenizer, Lexicon(src.read()))


KEPT["codec"] = codec.cache_clear


def _digests(tokenizer: str, lexicon: str):
    def run(batches):
        c = codec(tokenizer, lexicon)
        for b in batches:
            for at, ids, ends in c.encoded(b.column("text")):
                sums = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in c.joined(ids, ends, tokens)], pa.string()) for tokens in (False, True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(ends) - 1), pa.array(np.diff(ends), pa.int64()), *sums], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(tokenizer: str, lexicon: str):
    def run(batches):
        c = codec(tokenizer, lexicon)
        for b in batches:
            for at, ids, ends in c.encoded(b.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(ends) - 1), lists, c.joined(ids, ends, True).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text; a null text is an empty one and has no ids."""
    return map_arrow(_slim(docs, doc_id, text), _encoded(tokenizer, compile_lexicon(docs, tokenizer, text)), "doc_id long, ids array<int>, decoded string", "codec")


def encoded_digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, SHA-256 of its decimal ids joined by spaces and of the decoded text.

    Null and empty texts have no tokens. Repeated rows are encoded one by one; no documents give no rows.
    """
    return map_arrow(_slim(docs, doc_id, text), _digests(tokenizer, compile_lexicon(docs, tokenizer, text)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "codec")
