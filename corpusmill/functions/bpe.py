"""Byte-level BPE: special tokens, byte symbols, distributed training counts, encoding and decoding."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.files import file_system, read_json, write_json

#: Control tokens in the order of their ids.
SPECIAL_TOKENS = ["|<pad>|", "|<unknown>|", "|<bos>|", "|<eos>|", "|<sep>|", "|<cls>|", "|<mask>|", "|<system>|", "|<user>|", "|<assistant>|", "|<thinking>|", "|<end_of_thinking>|", "|<end_of_turn>|"]
SPECIAL = {t.strip("|<>"): i for i, t in enumerate(SPECIAL_TOKENS)}
#: Distinct pre-tokens that the driver may hold while it merges them.
DRIVER_WORDS = 500_000
#: Bytes of text that a task turns into ids at a time.
PART_BYTES = 4 << 20
#: Special tokens that have a common name.
NAMED = {"pad": "pad", "unk": "unknown", "bos": "bos", "eos": "eos", "sep": "sep", "cls": "cls", "mask": "mask"}
#: Fixed value: the public byte-level pre-token pattern; (?U) makes Java's classes Unicode ones.
PRETOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def byte_symbols() -> dict[int, str]:
    """Each byte's printable symbol: itself where Latin-1 has a visible sign, else the next beyond U+00FF."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Bpe:
    """A vocabulary: ids are specials, then byte symbols by code point, then merges in order."""

    merges: tuple[tuple[int, int], ...] = ()
    special_tokens: tuple[str, ...] = tuple(SPECIAL_TOKENS)
    allow_special: bool = True
    _made: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return {"merges": self.merges, "special_tokens": self.special_tokens, "allow_special": self.allow_special, "_made": {}}

    @property
    def first_byte(self) -> int:
        return len(self.special_tokens)

    def tables(self) -> dict:
        if not self._made:
            order = sorted(range(256), key=lambda b: byte_symbols()[b])
            to_id = {b: self.first_byte + i for i, b in enumerate(order)}
            pieces = {i: bytes([b]) for b, i in to_id.items()}
            ranks = {}
            for k, (a, b) in enumerate(self.merges):
                pieces[self.first_byte + 256 + k] = pieces[a] + pieces[b]
                ranks[a, b] = k
            special = {t: i for i, t in enumerate(self.special_tokens)}
            import regex

            of_byte = np.array([to_id[b] for b in range(256)], np.int32)
            self._made.update(to_id=to_id, of_byte=of_byte, pieces=pieces, ranks=ranks, special=special, cache={}, split=regex.compile(PRETOKEN.removeprefix("(?U)")).findall, cut=re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")"))
        return self._made

    def vocab_size(self) -> int:
        return self.first_byte + 256 + len(self.merges)

    def token_to_id(self, token: str) -> int:
        t = self.tables()
        if token in t["special"]:
            return t["special"][token]
        shown = {"".join(byte_symbols()[b] for b in piece): i for i, piece in t["pieces"].items()}
        if token not in shown:
            raise ValueError(f"unknown token {token!r}")
        return shown[token]

    def _word(self, word: str) -> list[int]:
        """The word's merges, the earliest rank first and of equal ones the leftmost.

        Symbols are linked to their neighbours; a heap holds the pairs that can merge, those that have changed
        meanwhile are passed over. So a word of n bytes takes n log n steps.
        """
        t = self.tables()
        ids: list[int] = [t["to_id"][b] for b in word.encode()]
        rank, new = t["ranks"].get, self.first_byte + 256
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or rank((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = new + r, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(ids) and (own := rank((ids[left], ids[after[left]]))) is not None:
                    heapq.heappush(heap, (own, left))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        t = self.tables()
        out: list[int] = []
        for part in t["cut"].split(text) if self.allow_special else [text]:
            if self.allow_special and part in t["special"]:
                out.append(t["special"][part])
            elif not self.merges:
                out.extend(map(t["to_id"].__getitem__, part.encode()))
            else:
                cache = t["cache"]
                if len(cache) > 200_000:
                    cache.clear()
                for word in t["split"](part):
                    if word not in cache:
                        cache[word] = self._word(word)
                    out.extend(cache[word])
        return out

    def array(self, text: str) -> np.ndarray:
        """encode() as int32; without merges and special strings all bytes are looked up at once."""
        t = self.tables()
        if self.merges or self.allow_special and any(s in text for s in self.special_tokens):
            return np.array(self.encode(text), np.int32)
        return t["of_byte"][np.frombuffer(text.encode(), np.uint8)]

    def decode(self, ids: list[int], skip_special: bool = True) -> str:
        pieces = self.tables()["pieces"]
        return b"".join(pieces[i] if i in pieces else b"" if skip_special else self.special_tokens[i].encode() for i in ids).decode("utf-8", "replace")

    def texts(self, ids: pa.Array) -> pa.Array:
        """decode() of lists of ids, null for null; pieces are taken by Arrow, and are not Python objects each. Ids without a piece give nothing."""
        t = self.tables()
        if "spelled" not in t:
            t["spelled"] = pa.array([t["pieces"].get(i, b"") for i in range(self.vocab_size())] + [b""], pa.large_binary())
        out = []
        for own in ids:
            if not own.is_valid:
                out.append(None)
                continue
            x = own.values.to_numpy(zero_copy_only=False)
            taken = t["spelled"].take(pa.array(np.where((x >= 0) & (x < self.vocab_size()), x, self.vocab_size())))
            _, ends, data = taken.buffers()
            size = np.frombuffer(ends, np.int64)[len(taken)] if len(taken) else 0
            out.append(str(memoryview(data)[:size], "utf-8", "replace") if size else "")
        return pa.array(out, pa.string())

    def tokenize(self, text: str) -> list[int]:
        return self.encode(text)

    def shown_names(self) -> pa.Array:
        """How each id is shown: its symbols, with spaces and line ends as themselves."""
        t = self.tables()
        if "names" not in t:
            names = ["".join(byte_symbols()[b] for b in t["pieces"][i]) for i in range(self.first_byte, self.vocab_size())]
            t["names"] = pa.array([x.replace("Ġ", " ").replace("Ċ", "\n") for x in (*self.special_tokens, *names)], pa.string())
        return t["names"]

    def dumps(self) -> str:
        return json.dumps({"special_tokens": self.special_tokens, "merges": self.merges}, ensure_ascii=False)

    @classmethod
    def loads(cls, text: str) -> Bpe:
        """From dumps() or from the public JSON form."""
        d = json.loads(text)
        if "model" in d:
            return cls.of_public(d)
        return cls(tuple(map(tuple, d["merges"])), tuple(d["special_tokens"]))

    def public(self) -> dict:
        """The tokenizer in the JSON form of the public tokenizers library, byte-level, with the same ids."""
        t = self.tables()
        shown = {i: "".join(byte_symbols()[b] for b in piece) for i, piece in t["pieces"].items()}
        added = [{"id": i, "content": c, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for c, i in t["special"].items()]
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        vocab = t["special"] | {s: i for i, s in sorted(shown.items())}
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [[shown[a], shown[b]] for a, b in self.merges]}
        return {"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": model}

    @classmethod
    def of_public(cls, d: dict) -> Bpe:
        special = [t["content"] for t in sorted(d["added_tokens"], key=lambda t: t["id"])]
        vocab, base = d["model"]["vocab"], cls((), tuple(special))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        if any(vocab[a + b] != base.first_byte + 256 + k for k, (a, b) in enumerate(pairs)) or any(vocab[byte_symbols()[b]] != i for b, i in base.tables()["to_id"].items()):
            raise ValueError("ids are not specials, byte symbols by code point, then merges in order")
        return cls(tuple((vocab[a], vocab[b]) for a, b in pairs), tuple(special))

    def special_map(self) -> dict:
        """Special tokens by what they are for; those without a common name are in one list."""
        named = {f"{n}_token": f"|<{w}>|" for n, w in NAMED.items() if f"|<{w}>|" in self.special_tokens}
        return named | {"extra_special_tokens": [t for t in self.special_tokens if t not in named.values()]}

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON file."""
        write_json(spark, path, self.public())

    def save_folder(self, spark: SparkSession, folder: str) -> None:
        """tokenizer.json and special_tokens_map.json."""
        self.save(spark, f"{folder}/tokenizer.json")
        write_json(spark, f"{folder}/special_tokens_map.json", self.special_map(), indent=2)

    @staticmethod
    def file_at(spark: SparkSession, path: str) -> str:
        """A tokenizer's file, given it or its folder."""
        fs, p = file_system(spark, path)
        return f"{path.rstrip('/')}/tokenizer.json" if fs.exists(p) and fs.getFileStatus(p).isDirectory() else path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bpe:
        return cls.of_public(read_json(spark, cls.file_at(spark, path)))


class Tokenizer(Protocol):
    """What packing asks of a tokenizer; it is pickled, by value where it is not of an importable module."""

    def tokenize(self, text: str) -> list[int]: ...


@lru_cache(maxsize=4)
def unpickled(data: bytes) -> Tokenizer:
    """One for each worker, so that its caches last."""
    return cloudpickle.loads(data)


def ids_of(tokenizer: Tokenizer, text: str) -> np.ndarray:
    return tokenizer.array(text) if isinstance(tokenizer, Bpe) else np.array(tokenizer.tokenize(text), np.int32)


def in_parts(text: pa.Array, limit: int = PART_BYTES) -> Iterator[pa.Array]:
    """Runs of texts with at most `limit` bytes, or of a single text; a batch may hold any number of bytes."""
    if not len(text):
        yield text
    start = total = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
        if k > start and total + n > limit:
            yield text[start:k]
            start, total = k, 0
        total += n
    if start < len(text):
        yield text[start:]


def id_lists(tokenizer: Tokenizer, text: pa.Array) -> pa.Array:
    """The ids of each text, null for null. Only one text's ids are Python objects at a time; a token has a byte or more, so what is set aside at first is enough for most."""
    flat, ends, at = np.empty(pc.sum(pc.binary_length(text)).as_py() or 0, np.int32), np.zeros(len(text) + 1, np.int32), 0
    for k, own in enumerate(text):
        if own.is_valid:
            ids = ids_of(tokenizer, own.as_py())
            if at + len(ids) > len(flat):
                flat = np.concatenate([flat[:at], np.empty(at + len(ids), np.int32)])
            flat[at : at + len(ids)] = ids
            at += len(ids)
        ends[k + 1] = at
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[:at]), mask=pc.is_null(text) if text.null_count else None)


def encode_udf(tokenizer: Tokenizer):  # noqa: ANN201
    """text -> array<int>, at most PART_BYTES of text at a time; the vocabulary travels once, as a broadcast of bounded size."""
    shared = SparkSession.active().sparkContext.broadcast(cloudpickle.dumps(tokenizer))

    @F.arrow_udf("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = unpickled(shared.value)
        for text in texts:
            for part in in_parts(text):
                yield id_lists(one, part)

    return encode


def decode_udf(bpe: Bpe):  # noqa: ANN201
    """array<int> -> text; special tokens are left out."""
    shared = SparkSession.active().sparkContext.broadcast(bpe)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return shared.value.texts(ids)

    return decode


def byte_tokens(text: Column) -> Column:
    """What the vocabulary without merges gives, for texts without special strings: within the JVM."""
    base = Bpe()
    to_id = base.tables()["to_id"]
    shown = F.array(*[F.lit(to_id[b]) for b in range(256)])
    digits = F.split(F.regexp_replace(F.hex(text.cast("binary")), "(..)", "$1 "), " ")
    codes = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.element_at(F.transform(F.array(shown), lambda table: F.transform(codes, lambda c: F.element_at(table, c + 1))), 1)


def inspected(df: DataFrame, text: str, bpe: Bpe) -> DataFrame:
    """df with ids, decoded_text, formatted_tokens, and all of it as one JSON string `inspection`."""
    shared = df.sparkSession.sparkContext.broadcast(bpe)

    @F.arrow_udf("struct<ids: array<int>, decoded_text: string, formatted_tokens: array<string>>")
    def shown(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for text in texts:
            for part in in_parts(text):
                ids = id_lists(own, part)
                names = own.shown_names().take(ids.values)
                tokens = pa.ListArray.from_arrays(ids.offsets, names, mask=pc.is_null(ids) if ids.null_count else None)
                yield pa.StructArray.from_arrays([ids, own.texts(ids), tokens], ["ids", "decoded_text", "formatted_tokens"])

    out = df.withColumn("shown_", shown(text)).select(*df.columns, "shown_.*")
    return out.withColumn("inspection", F.to_json(F.struct(F.col(text).alias("text"), "ids", "decoded_text", "formatted_tokens")))


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def pretoken_counts(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(pretokens(F.col(text))).alias("pretoken")).groupBy("pretoken").agg(F.count("*").alias("n"))


class TooManyWords(ValueError):
    """There are more distinct pre-tokens than the driver is to hold."""


def train(df: DataFrame, text: str, vocab_size: int = 65536, least: int = 1, most_words: int = DRIVER_WORDS) -> Bpe:
    """Count pre-tokens in Spark, merge on the driver over the distinct ones: for few of them (refused beyond `most_words`).

    bpe_training.train_partitioned makes the same vocabulary of any number.
    """
    counts = pretoken_counts(df, text).filter(F.col("n") >= least).limit(most_words + 1).toArrow()
    if counts.num_rows > most_words:
        raise TooManyWords(f"more than {most_words} distinct pre-tokens")
    return merge_words(list(zip(counts["pretoken"].to_pylist(), counts["n"].to_pylist(), strict=True)), vocab_size)


def merge_words(words: list[tuple[str, int]], vocab_size: int) -> Bpe:
    """The most frequent pair first, ties by the smaller ids.

    All words lie in one array of symbols, linked to what follows and precedes them; a pair's places are
    kept by pair and looked at again when it is merged, so the work goes with the changes.
    """
    words = sorted(words)
    new, top = len(SPECIAL_TOKENS) + 256, max(vocab_size, len(SPECIAL_TOKENS) + 256) + 1
    symbol = np.full(256, -1, np.int64)
    for byte, i in Bpe().tables()["to_id"].items():
        symbol[byte] = i
    symbol[255] = -1  # no byte of UTF-8: it ends a word
    coded = [w.encode() for w, _ in words]
    x = symbol[np.frombuffer(b"\xff".join([b"", *coded, b""]), np.uint8)]
    weight = np.zeros(len(x), np.int64)
    weight[1:] = np.repeat([n for _, n in words], [len(c) + 1 for c in coded])
    after, before = np.arange(1, len(x) + 1), np.arange(-1, len(x) - 1)
    count: dict[int, int] = {}
    places: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def edges(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, place) of the places where a pair begins."""
        at = at[(x[at] >= 0) & (x[after[at]] >= 0)]
        return x[at] * top + x[after[at]], at

    def tell(at: np.ndarray, sign: int) -> None:
        """Count the pairs that begin at these places, or take them off; new ones are listed."""
        pair, at = edges(at)
        if not len(pair):
            return
        by = np.argsort(pair, kind="stable")
        pair, at = pair[by], at[by]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        sums = np.add.reduceat(weight[at], first)
        for key, n, own in zip(pair[first].tolist(), sums.tolist(), np.split(at, first[1:]), strict=True):
            count[key] = count.get(key, 0) + sign * n
            if sign > 0:
                places.setdefault(key, []).append(own)
                heapq.heappush(heap, (-count[key], key))

    tell(np.arange(len(x) - 1), 1)
    merges: list[tuple[int, int]] = []
    while new < vocab_size and heap:
        n, key = heapq.heappop(heap)
        if count[key] != -n:
            if count[key] > 0:
                heapq.heappush(heap, (-count[key], key))
            continue
        if n == 0:
            break
        a, b = divmod(key, top)
        at = np.unique(np.concatenate(places.pop(key)))
        at = at[(x[at] == a) & (x[np.minimum(after[at], len(x) - 1)] == b)]
        if a == b and len(at):  # of a run, every other place
            start = np.flatnonzero(np.concatenate([[True], at[1:] != after[at[:-1]]]))
            run = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
            at = at[run % 2 == 0]
        gone = after[at]
        touched = np.unique(np.concatenate([before[at], at, gone]))
        tell(touched, -1)
        x[at] = new
        x[gone] = -2
        after[at] = after[gone]
        before[after[at]] = at
        tell(np.unique(np.concatenate([before[at], at])), 1)
        merges.append((a, b))
        new += 1
    return Bpe(tuple(merges))
