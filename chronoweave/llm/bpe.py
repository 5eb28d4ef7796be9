"""Byte-pair encoding of whole texts with a public vocabulary, on numpy matrices."""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers lie.
FOLDER = "/opt/tokenizers"
# Fixed value: how byte-level vocabularies cut texts before merging, unless they name a pattern of their own.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of up to so many bytes are merged in matrices, longer ones with a heap, which does the same merges in n log n.
WIDEST = 128
#: Texts are taken in portions of about so many characters, and encoded pieces are kept until there are so many.
PORTION, KEPT = 2_000_000, 400_000
_NONE = np.int32(2**31 - 1)
_EMPTY = np.int64(-1)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary's JSON: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """A public vocabulary with its merges in a hash table of pairs.

    ``name`` is a file in ``folder``, with or without its ending: ``.json`` files with byte-level BPE (with a normalizer, a
    pattern of their own and marked word ends, or without), and ``.tiktoken`` files of ranks, which are cut by PATTERN. What a
    file asks for and isn't known here is refused with a ValueError: no text is ever encoded by other rules than the file's.
    """

    def __init__(self, name: str = "byte_bpe_50k", folder: str = FOLDER) -> None:
        files = [Path(folder, name), Path(folder, f"{name}.json"), Path(folder, f"{name}.tiktoken")]
        path = next((p for p in files if p.is_file() and p.suffix in (".json", ".tiktoken")), None)
        if path is None:
            raise ValueError(f"{name}: no vocabulary of byte-level merges (.json, .tiktoken) in {folder}")
        self.pattern, self.steps, self.whole = PATTERN, [], {}
        if path.suffix == ".json":
            self._read_merges(json.loads(path.read_text(encoding="utf-8")), path.name)
        else:
            self._read_ranks(path)

    def _read_merges(self, spec: dict, name: str) -> None:
        model = spec["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd:
            raise ValueError(f"{name}: a model with {odd or model['type']} isn't supported")
        for step in (spec.get("normalizer") or {"normalizers": []}).get("normalizers", [spec.get("normalizer")]):
            kind = step["type"]
            if kind == "Replace" and "Regex" in step["pattern"]:
                self.steps.append((kind, step["pattern"]["Regex"], step["content"]))
            elif kind in ("NFC", "Lowercase"):
                self.steps.append((kind, "", ""))
            else:
                raise ValueError(f"{name}: the normalizer {kind} isn't supported")
        cuts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        *splits, last = cuts
        whole = last["type"] == "ByteLevel" and not last["add_prefix_space"]
        if whole and last["use_regex"] and not splits:
            self.pattern = PATTERN
        elif whole and not last["use_regex"] and len(splits) == 1 and splits[0]["type"] == "Split" and splits[0]["behavior"] == "Removed" and splits[0]["invert"]:
            self.pattern = splits[0]["pattern"]["Regex"]
        else:
            raise ValueError(f"{name}: its way of cutting texts isn't supported")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first, self.last = np.zeros(256, dtype=np.int32), np.zeros(256, dtype=np.int32)
        for letter, byte in _byte_letters().items():
            self.first[byte], self.last[byte] = vocab[letter], vocab[letter + end]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self._build(left << 32 | right, made, np.arange(len(pairs), dtype=np.int32))

    def _read_ranks(self, path: Path) -> None:
        """Any two tokens that make a third are a pair, with the third's rank; a piece that is a token itself isn't cut."""
        self.whole = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.read_bytes().splitlines())}
        self.first = np.array([self.whole[bytes([b])] for b in range(256)], dtype=np.int32)
        self.last = self.first
        found = [(self.whole[t[:k]] << 32 | self.whole[t[k:]], rank) for t, rank in self.whole.items() for k in range(1, len(t)) if t[:k] in self.whole and t[k:] in self.whole]
        made = np.array([r for _, r in found], dtype=np.int32)
        self._build(np.array([k for k, _ in found], dtype=np.int64), made, made)

    def normal(self, text: str) -> str:
        """The text as the vocabulary wants it before it is cut."""
        for kind, pattern, content in self.steps:
            if kind == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif kind == "Replace":
                text = regex.sub(pattern, content, text)
            else:  # letter by letter, so that a sigma at a word's end is no exception
                text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return text

    def _build(self, keys: np.ndarray, made: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing in a table four times as large as needed at least."""
        self.bits = int(np.ceil(np.log2(4 * max(2, len(keys)))))
        size = 1 << self.bits
        self.keys, self.rank, self.made = np.full(size, _EMPTY), np.full(size, _NONE, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        for k, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[slot] != _EMPTY:
                slot = (slot + 1) & (size - 1)
            self.keys[slot], self.rank[slot], self.made[slot] = key, ranks[k], made[k]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table slot of each pair, or of an empty place for what is no pair (also if a side is padding, -1)."""
        keys = left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(keys)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there != _EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != _EMPTY)]
        return slot

    def _merge_matrix(self, ids: np.ndarray, out: list[np.ndarray], place: np.ndarray) -> None:
        """Rows of equal padded width (-1 at the end). Each round every row merges its leftmost pair of the lowest rank; rows
        without a pair leave, and the columns that became empty go."""
        n, width = ids.shape
        slots = self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.zeros((n, 0), np.int64)
        ranks = self.rank[slots]
        while len(place):
            if ids.shape[1] > 1:
                best = ranks.argmin(axis=1)
                lowest = ranks[np.arange(len(place)), best]
            else:
                best, lowest = np.zeros(len(place), np.int64), np.full(len(place), _NONE)
            done = lowest == _NONE
            if done.any():
                for row, at in zip(ids[done], place[done], strict=True):
                    out[at] = row[row >= 0]
                live = ~done
                ids, slots, ranks, place, best = ids[live], slots[live], ranks[live], place[live], best[live]
                if not len(place):
                    return
            rows = np.arange(len(place))
            ids[rows, best] = self.made[slots[rows, best]]
            columns = np.arange(ids.shape[1] - 1)
            take = columns + (columns > best[:, None])  # what stands right of the merged pair moves one to the left
            merged = np.take_along_axis(ids, np.minimum(take, ids.shape[1] - 1), axis=1)
            ids = merged
            moved = take[:, :-1]
            slots, ranks = np.take_along_axis(slots, moved, axis=1), np.take_along_axis(ranks, moved, axis=1)
            for shift in (-1, 0):  # the pairs on both sides of the new id are new
                at = best + shift
                ok = (at >= 0) & (at < ids.shape[1] - 1)
                if ok.any():
                    r, c = rows[ok], at[ok]
                    fresh = self.find(ids[r, c], ids[r, c + 1])
                    slots[r, c], ranks[r, c] = fresh, self.rank[fresh]
            used = int((ids >= 0).sum(axis=1).max())
            if used < ids.shape[1]:
                ids, slots, ranks = ids[:, :used], slots[:, : max(0, used - 1)], ranks[:, : max(0, used - 1)]

    def _merge_long(self, data: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.first[np.frombuffer(data, dtype=np.uint8)]
        ids[-1] = self.last[data[-1]]
        slots = self.find(ids[:-1], ids[1:])
        ranks = self.rank[slots]
        ids = ids.tolist()
        nxt, prev = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(int(r), k, ids[k], ids[k + 1]) for k, r in enumerate(ranks.tolist()) if r != _NONE]
        heapq.heapify(heap)
        memo: dict[tuple[int, int], tuple[int, int]] = {}
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = nxt[k] if ids[k] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[k], ids[j] = self._pair(a, b, memo)[1], -1
            nxt[k] = nxt[j]
            if nxt[k] < len(ids):
                prev[nxt[k]] = k
            for p, q in ((prev[k], k), (k, nxt[k])):
                if p >= 0 and q < len(ids) and (rank := self._pair(ids[p], ids[q], memo)[0]) != _NONE:
                    heapq.heappush(heap, (rank, p, ids[p], ids[q]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def _pair(self, a: int, b: int, memo: dict[tuple[int, int], tuple[int, int]]) -> tuple[int, int]:
        if (found := memo.get((a, b))) is None:
            slot = self.find(np.array([a]), np.array([b]))[0]
            found = memo[(a, b)] = (int(self.rank[slot]), int(self.made[slot]))
        return found

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. Pieces are put together by length, so that a matrix has little padding."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 1
        low = 0
        while low < WIDEST:
            inside = np.flatnonzero((sizes > low) & (sizes <= width))
            for lot in np.array_split(inside, max(1, -(-len(inside) * width // 1_000_000))):
                if len(lot):
                    text = b"".join(pieces[k] for k in lot)
                    ids = np.full((len(lot), width), -1, dtype=np.int32)
                    inner = np.arange(width) < sizes[lot][:, None]
                    ids[inner] = self.first[data := np.frombuffer(text, dtype=np.uint8)]
                    ids[np.arange(len(lot)), sizes[lot] - 1] = self.last[data[np.cumsum(sizes[lot]) - 1]]
                    self._merge_matrix(ids, out, lot)
            low, width = width, width + max(1, width // 2)
            width = min(width, WIDEST)
            if low == WIDEST:
                break
        for k in np.flatnonzero(sizes > WIDEST):
            out[k] = self._merge_long(pieces[k])
        if self.whole:
            for k, piece in enumerate(pieces):
                if piece in self.whole:
                    out[k] = np.array([self.whole[piece]], dtype=np.int32)
        return out


class _Kept:
    """Encoded pieces by text, as slices of one array."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder, self.cut = encoder, regex.compile(encoder.pattern)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        if len(self.at) > KEPT:
            self.clear()
        cut = [self.cut.findall(self.encoder.normal(t)) for t in texts]
        fresh = [p for p in dict.fromkeys(p for parts in cut for p in parts) if p not in self.at]
        if fresh:
            new = self.encoder.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh])
            for p in fresh:
                self.at[p] = len(self.at)
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
            self.sizes, self.ids = np.r_[self.sizes, sizes], np.concatenate([self.ids, *new])
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        codes = np.fromiter((self.at[p] for parts in cut for p in parts), np.int64, int(counts.sum()))
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[codes] - ends + sizes, sizes) + np.arange(total)]
        edge = np.r_[0, np.cumsum(counts)]
        upto = np.r_[0, ends]
        return ids, upto[edge[1:]] - upto[edge[:-1]]


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= PORTION:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _task(sent, only_counts: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(sent.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            rest = batch.columns[1:]
            for lo, hi in _portions(texts):
                ids, counts = kept.encode(texts[lo:hi])
                if only_counts:
                    made: pa.Array = pa.array(counts, pa.int64())
                else:
                    made = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in rest), made], [*batch.schema.names[1:], "__made"])

    return run


def _encoded(df: DataFrame, text: str, keep: list[str], out: str, kind: str, name: str, folder: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(Encoder(name, folder))  # a vocabulary: a few MB, whatever the data
    rows = df.select(F.col(text).alias("__text"), *[F.col(c).alias(f"__k{k}") for k, c in enumerate(keep)])
    schema = ", ".join([*(f"__k{k} {df.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), f"__made {kind}"])
    made = rows.mapInArrow(_task(sent, kind == "bigint"), schema)
    return made.select(*[F.col(f"__k{k}").alias(c) for k, c in enumerate(keep)], F.col("__made").alias(out))


def token_ids(df: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` and ``ids``: the ids of the whole text by the vocabulary ``name`` (see Encoder), special tokens'
    strings being ordinary text.

    Each task cuts its texts, and merges the distinct pieces it meets in matrices of pieces of like length. Nothing is
    shuffled. Null and empty texts keep their row and get an empty list. ``folder`` is read where the plan is made.
    """
    return _encoded(df, text, keep, "ids", "array<int>", name, folder)


def token_counts(df: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` and ``tokens``: the number of ids of the whole text, 0 for null and empty texts."""
    return _encoded(df, text, keep, "tokens", "bigint", name, folder)
