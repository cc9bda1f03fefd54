"""BPE encoding and decoding by a table of distinct words.

Texts are split into pre-tokens (words). Blocks of documents keep, for each document, the positions
of its words in the block's own word list; only these word lists are dealt out by word, so that each
distinct word is encoded once, and the ids come back to their block and are joined to the documents
by position. Decoding joins the ids to a table of pieces.

What is shuffled: word lists and positions, compressed in packets; never a row per word. Memory: a
block's words (BLOCK_WORDS, and those of one more text), or, of one bucket at a time, the ids of at most
KNOWN_WORDS distinct words; a bucket that has more forgets and encodes some again, with the same ids.
The joins are by position in arrays: both sides of a block are in one task.

Defined results: null and empty texts have no ids (hashes of the empty text); strings of special
tokens inside texts get their own ids; null and repeated identifiers pass through, row by row; very
long texts are treated whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load_tokenizer, slices, small_batches, stored, trimmed

#: Characters and distinct words after which a block ends.
BLOCK_CHARS = 32 << 20
BLOCK_WORDS = 1 << 20
#: Words of documents in one packet (one document may have more), and the code of words beyond a block's commonest.
PACKET_WORDS = 1 << 20
ESCAPE = 0xFFFF
#: Texts that a worker holds as Python strings.
SLICE = 256
#: Buckets of words for each shuffle partition, and at most: a block has a packet for each, of some hundred words at least.
BUCKETS_PER_PARTITION, MOST_BUCKETS = 2, 4096
#: Distinct words whose ids a worker keeps.
KNOWN_WORDS = 2 << 20

#: Fixed value: the pattern of byte-level pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters for which ``regex`` and the tokenizer library know the same classes; other texts are split by the library.
_KNOWN = "\\x00-\\u0557\\u1e00-\\u1fff\\u2010-\\u205e\\u20ac\\u2190-\\u21ff\\u3000-\\u3029\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3"
_OTHER = re.compile(f"[^{_KNOWN}]")


def _zip(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=9).compress(a.tobytes())


def _unzip(b: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=kind)


class Splitter:
    """Splits a text into words exactly as the tokenizer file's pre-tokenizer does."""

    def __init__(self, path: str):
        import regex

        self.find = regex.compile(PRE_TOKEN).findall
        self.pre = load_tokenizer(path).pre_tokenizer
        added = sorted((t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.known = set(added)

    def plain(self, text: str) -> list[str]:
        if _OTHER.search(text):
            return [text[a:z] for _, (a, z) in self.pre.pre_tokenize_str(text)]
        return self.find(text)

    def __call__(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.known else self.plain(part)
        return out


class _Places(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


PACKET = "block long, kind int, bucket int, base long, ids array<long>, sizes array<int>, data binary"
_PACKET = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("base", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKET, strict=True)], schema=_PACKET)


def _planes(code: np.ndarray, rare: np.ndarray) -> bytes:
    """Codes of two bytes, then the places of escaped words, plane by plane: bytes that are alike stand together."""
    c, r = code.view(np.uint8), rare.astype(np.uint32).view(np.uint8)
    return _zip(np.concatenate([c[0::2], c[1::2], r[0::4], r[1::4], r[2::4], r[3::4]]))


def _places(data: bytes, n: int, top: np.ndarray) -> np.ndarray:
    """The positions in the block's word list that ``_planes`` wrote."""
    flat = _unzip(data, np.uint8)
    code = np.stack([flat[:n], flat[n : 2 * n]], axis=1).view(np.uint16).ravel()
    k = (len(flat) - 2 * n) // 4
    rare = np.ascontiguousarray(flat[2 * n :].reshape(4, k).T).view(np.uint32).ravel()
    out = np.empty(n, np.int64)
    escaped = code == ESCAPE
    out[escaped] = rare
    out[~escaped] = top[code[~escaped]]
    return out


def _packets(path: str, n_buckets: int, block_chars: int = BLOCK_CHARS, packet_words: int = PACKET_WORDS):
    """Documents to packets: kind 0 a block's words of one bucket, kind 1 its commonest words, then documents' positions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seq, part = Splitter(path), 0, TaskContext.get().partitionId()
        words, ids, places, chars = _Places(), [], [], 0

        def flush():
            nonlocal words, ids, places, chars, seq
            block, seq = (part << 24) + seq, seq + 1
            raw = [w.encode() for w in words]
            words = _Places()
            bucket = [zlib.crc32(w) % n_buckets for w in raw]
            # a bucket's words in byte order: neighbours share beginnings, which compress away
            order = sorted(range(len(raw)), key=lambda i: (bucket[i], raw[i]))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ends = np.searchsorted(np.array(bucket, np.int64)[order] if order else np.zeros(0, np.int64), np.arange(n_buckets + 1))
            for b in range(n_buckets):
                a, z = int(ends[b]), int(ends[b + 1])
                if z > a:
                    mine = [raw[i] for i in order[a:z]]
                    yield _rows([(block, 0, b, a, None, None, _zip(np.frombuffer(np.array(list(map(len, mine)), np.int32).tobytes() + b"".join(mine), np.uint8)) + (z - a).to_bytes(4, "little"))])
            del raw, bucket, order
            size = [len(p) for p in places]
            every, places = np.concatenate(places), []
            top = np.argsort(-np.bincount(every, minlength=len(rank)), kind="stable")[:ESCAPE]
            code = np.full(len(rank), ESCAPE, np.uint16)
            code[top] = np.arange(len(top))
            yield _rows([(block, 1, None, -1, None, None, _zip(rank[top].astype(np.uint32)))])
            at = begin = 0
            while at < len(ids):
                z, n = at, 0
                while z < len(ids) and (z == at or n + size[z] <= packet_words):
                    n, z = n + size[z], z + 1
                mine = every[begin : begin + n]
                c = code[mine]
                yield _rows([(block, 1, None, at, ids[at:z], size[at:z], _planes(c, rank[mine[c == ESCAPE]]))])
                at, begin = z, begin + n
            ids, chars = [], 0

        for b in slices(batches, SLICE):
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = split(t)
                ids.append(i)
                places.append(np.fromiter(map(words.__getitem__, w), np.int32, len(w)))
                chars += len(t)
                if chars >= block_chars or len(words) >= BLOCK_WORDS:
                    yield from flush()
        if ids:
            yield from flush()

    return pack


def _encoded(path: str, most: int = KNOWN_WORDS):
    """Word packets, sorted by bucket, to id packets; a word that several blocks have is encoded the first time only."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known, current = load_tokenizer(path), {}, None
        for b in batches:
            for blk, bucket, base, data in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "base", "data")), strict=True):
                n = int.from_bytes(data[-4:], "little")
                flat = _unzip(data[:-4], np.uint8)
                size = np.frombuffer(flat[: 4 * n].tobytes(), np.int32)
                body, at, mine = flat[4 * n :].tobytes(), 0, []
                for s in size.tolist():
                    mine.append(body[at : at + s])
                    at += s
                if bucket != current or len(known) > most:
                    known, current = {}, bucket
                new = [w for w in mine if w not in known]
                for w, e in zip(new, tok.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, np.uint32)
                got = [known[w] for w in mine]
                yield _rows([(blk, 0, bucket, base, None, None, _zip(np.concatenate([np.fromiter(map(len, got), np.uint32, n), *got])) + n.to_bytes(4, "little"))])

    return encode


def piece_bytes(path: str) -> list[bytes]:
    """The bytes of each id. Byte-level vocabularies write a byte as itself if it is printable, else as the next character from 256 on."""
    tok = load_tokenizer(path)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    out = []
    for i in range(tok.get_vocab_size(with_added_tokens=True)):
        p = tok.id_to_token(i) or ""
        out.append(bytes(back[c] for c in p) if all(c in back for c in p) else p.encode())
    return out


def _assembled(path: str, whole: bool):
    """A block's id packets, then its documents: ids by position, and the decoded text."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(piece_bytes(path), pa.binary())
        numbers = pa.array([str(i) for i in range(len(pieces))], pa.string())
        block, packets, table = None, [], None

        def made():
            sizes, flats = [], []
            for data in packets:
                n = int.from_bytes(data[-4:], "little")
                flat = _unzip(data[:-4], np.uint32)
                sizes.append(flat[:n])
                flats.append(flat[n:])
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.uint32)
            ids = np.concatenate(flats) if flats else np.zeros(0, np.uint32)
            ends = pa.array(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), pa.int32())
            at = pa.array(ids)
            joined = lambda what, sep: pc.binary_join(pa.ListArray.from_arrays(ends, what.take(at)), sep)
            return size.astype(np.int64), joined(numbers, ","), joined(pieces, b"")

        def docs(ids, sizes, at):
            size, text_ids, text = table
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            where, ends_a = pa.array(at), pa.array(ends, pa.int32())
            id_text = pc.binary_join(pa.ListArray.from_arrays(ends_a, text_ids.take(where)), ",").to_pylist()
            decoded = [x.decode("utf-8", "replace") for x in pc.binary_join(pa.ListArray.from_arrays(ends_a, text.take(where)), b"").to_pylist()]
            total = np.concatenate([[0], np.cumsum(size[at])])
            cols = [pa.array(ids, pa.int64()), pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in id_text]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if whole:
                cols += [pa.array([[int(v) for v in x.split(",")] if x else [] for x in id_text], pa.list_(pa.int32())), pa.array(decoded)]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(cols, names=names)

        top = None
        for b in batches:
            for blk, kind, base, ids, sizes, data in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "base", "ids", "sizes", "data")), strict=True):
                if blk != block:
                    block, packets, table = blk, [], None
                if kind == 0:
                    packets.append(data)
                elif base < 0:
                    table, top, packets = made(), _unzip(data, np.uint32), []
                else:
                    yield docs(ids, sizes, _places(data, sum(sizes), top))

    return assemble


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, block_chars: int = BLOCK_CHARS, packet_words: int = PACKET_WORDS) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256; with ``whole`` also ids and decoded."""
    small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = min(BUCKETS_PER_PARTITION * parts, MOST_BUCKETS)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = stored(src.mapInArrow(trimmed(_packets(path, n_buckets, block_chars, packet_words)), PACKET), "bpe")
    # tasks by the data's size: a block, or about as much of the word lists, each; a session's own number where that is more
    n_blocks = packed.where("kind = 1 and base < 0").count()
    ids = packed.where("kind = 0").repartition(max(parts, min(n_buckets, n_blocks)), "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_encoded(path)), PACKET)
    both = ids.unionByName(packed.where("kind = 1")).repartition(max(parts, n_blocks), "block").sortWithinPartitions("block", "kind", "base")
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if whole else "")
    return both.mapInArrow(trimmed(_assembled(path, whole)), schema).withColumnRenamed("id", id_col)
