"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the model's own compiled character map: at each position the longest
prefix in the map's double-array trie is replaced, and every byte written remembers the source
byte it came from. The normalised text is cut where no piece of the vocabulary can reach across
(before a run of the space mark, and around line feeds if no piece holds one), so a segment's
pieces don't depend on its neighbours and are kept in a bounded cache. A piece's bytes in the
normalised text are then projected back through the alignment to a span of original bytes.

Null text counts as empty. Empty text has the end id only. Text of any length is encoded whole.
Extra columns, whatever their names, are not read; repeated rows give repeated results; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import q

#: The mark that stands for a space in pieces. Fixed by the format.
MARK = "▁"
#: Piece types of the format. Fixed values.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments a worker keeps; when the newer half is full, what hasn't been met since the last time goes.
CACHE_SEGMENTS = 400_000
#: Longer segments are encoded each time and not kept.
CACHE_CHARS = 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def proto_fields(data: bytes) -> Iterator[tuple[int, int, object, bytes]]:
    """(field, wire type, value, raw bytes) of a serialised protocol-buffer message."""
    i = 0
    while i < len(data):
        start = i
        key, i = _varint(data, i)
        field, kind = key >> 3, key & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = struct.unpack("<f" if kind == 5 else "<d", data[i : i + n])[0], i + n
        yield field, kind, value, data[start:i]


def _delimited(field: int, body: bytes) -> bytes:
    out, n = bytearray([field << 3 | 2]), len(body)
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out) + body


class CharacterMap:
    """The compiled map: a double-array trie over source bytes whose values point at replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.targets = blob[4 + size :]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes | None]:
        """(length, replacement) of the longest mapped prefix of data[start:]; (0, None) if there is none."""
        best, target = 0, None
        if not self.units:
            return best, target
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        at = step(self.units[0])
        for i in range(start, len(data)):
            at ^= data[i]
            if at >= len(self.units) or (unit := self.units[at]) & 0x800000FF != data[i]:
                break
            at ^= step(unit)
            if unit >> 8 & 1:
                begin = self.units[at] & 0x7FFFFFFF
                best, target = i + 1 - start, self.targets[begin : self.targets.index(b"\0", begin)]
        return best, target


class PieceModel:
    """A model file's vocabulary, normaliser and segmentation, with a cached encoder."""

    def __init__(self, data: bytes):
        self.data = data
        self.pieces, self.scores, self.types = [], [], []
        spec: dict[int, object] = {}
        outer = b""
        for field, _, value, raw in proto_fields(data):
            if field == 1:
                x = {f: v for f, _, v, _ in proto_fields(value)}
                self.pieces.append(x[1].decode("utf-8"))
                self.scores.append(x.get(2, 0.0))
                self.types.append(x.get(3, NORMAL))
            elif field == 3:
                spec = {f: v for f, _, v, _ in proto_fields(value)}
            if field != 3:
                outer += raw
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        #: The same vocabulary behind a normaliser that changes nothing; it only ever sees normalised segments.
        self.inner_proto = outer + _delimited(3, _delimited(1, b"identity") + b"\x18\x00\x20\x00\x28\x00")
        usable = [p for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER)]
        self.plain = not self.map.units and not self.squeeze and self.escape and USER not in self.types
        feed = "" if any("\n" in p for p in usable) else "\n"
        if any(MARK in p.lstrip(MARK) for p in usable) or USER in self.types:
            self.segments = re.compile(r"(?s).+")
        else:
            stop = MARK + feed
            self.segments = re.compile(rf"{feed}[^{stop}]*|{MARK}+[^{stop}]*|[^{stop}]+" if feed else rf"{MARK}+[^{stop}]*|[^{stop}]+")
        end = [i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == CONTROL and p == "</s>"]
        self.end_id = end[0] if end else None
        #: Where a piece's bytes don't follow from its id alone: unknown characters of models that don't fall back to bytes.
        self.inexact = BYTE not in self.types
        value = [int(p[3:5], 16) if t == BYTE else 0 for p, t in zip(self.pieces, self.types, strict=True)]
        self.follows = np.array([t == BYTE and 0x80 <= v < 0xC0 for v, t in zip(value, self.types, strict=True)])
        width = lambda v: 1 if v < 0xC0 else 2 if v < 0xE0 else 3 if v < 0xF0 else 4
        #: Source bytes that a piece moves on by: of a character that fell back to bytes, its first byte moves by all.
        self.steps = np.array([(0 if f else width(v)) if t == BYTE else len(p.encode("utf-8")) for p, t, v, f in zip(self.pieces, self.types, value, self.follows, strict=True)], np.int32)
        self.decimal = [str(i) for i in range(len(self.pieces))]
        #: Ids whose text isn't simply their piece's.
        self.odd = frozenset(i for i, t in enumerate(self.types) if t in (UNKNOWN, CONTROL, BYTE))
        self._new: dict[str, tuple] = {}
        self._old: dict[str, tuple] = {}
        self._inner = None

    def __getstate__(self):
        return {"data": self.data}

    def __setstate__(self, state):
        self.__init__(state["data"])

    # -- normalisation ------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its UTF-8 bytes (and its end) the source byte it starts from."""
        data = text.encode("utf-8")
        out, source, i = bytearray(), [], 0
        space = MARK.encode() if self.escape else b" "
        prefix = lambda i: self._prefix(data, i)
        if self.squeeze:
            while i < len(data):
                n, piece = prefix(i)
                if piece != b" ":
                    break
                i += n
        if i == len(data):
            return "", [i]
        if self.dummy_prefix:
            out += space
            source += [i] * len(space)
        after_space = self.squeeze
        while i < len(data):
            n, piece = prefix(i)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                written = piece.replace(b" ", space) if self.escape else piece
                out += written
                source += [i] * len(written)
                after_space = self.squeeze and piece.endswith(b" ")
            i += n
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                i = source[len(out)]
                del source[len(out) :]
        source.append(i)
        return out.decode("utf-8"), source

    def _prefix(self, data: bytes, i: int) -> tuple[int, bytes]:
        n, target = self.map.longest(data, i)
        if n:
            return n, target
        lead = data[i]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[i : i + n]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """What normalise() gives, the sources as an array; where only spaces change, all bytes are aligned at once."""
        if not self.plain:
            normal, source = self.normalise(text)
            return normal, np.array(source, np.int32)
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        if not len(data):
            return "", np.zeros(1, np.int32)
        mark = len(MARK.encode("utf-8"))
        start = np.arange(len(data), dtype=np.int32)
        if not text.isascii():
            start = np.maximum.accumulate(np.where((data & 0xC0) == 0x80, np.int32(0), start))
        source = np.repeat(start, np.where(data == 0x20, mark, 1))
        lead = np.zeros(mark * self.dummy_prefix, np.int32)
        return MARK * self.dummy_prefix + text.replace(" ", MARK), np.concatenate([lead, source, np.array([len(data)], np.int32)])

    # -- encoding -----------------------------------------------------------------------------

    @property
    def inner(self):
        if self._inner is None:
            import sentencepiece

            self._inner = sentencepiece.SentencePieceProcessor(model_proto=self.inner_proto)
        return self._inner

    def moves(self, segment: str, ids: list[int]) -> bytes:
        """Bytes of the segment that each piece moves on by, as 32-bit integers, unknown characters as they stand in it."""
        surface = self.inner.encode(segment, out_type=str)
        return array("i", [len(x.encode("utf-8")) for x in surface]).tobytes()

    def lookup(self, segments: list[str]) -> list[tuple[bytes, bytes, bytes, bytes]]:
        """For each segment: ids as 32-bit integers, ids as decimal text, decoded bytes, and moves() where ids don't tell them."""
        new, old = self._new, self._old
        found = list(map(new.get, segments))
        if None not in found:
            return found
        fresh: dict[str, tuple] = {}
        for s in {s for s, e in zip(segments, found, strict=True) if e is None}:
            if (e := old.get(s)) is not None:
                new[s] = e
            else:
                fresh[s] = ()
        texts, decimal, odd = list(fresh), self.decimal, self.odd
        for s, ids in zip(texts, self.inner.encode(texts, num_threads=1), strict=True):
            decoded = s.replace(MARK, " ").encode("utf-8") if odd.isdisjoint(ids) else self.decode_bytes(ids)
            fresh[s] = (array("i", ids).tobytes(), " ".join([decimal[k] for k in ids]).encode(), decoded, self.moves(s, ids) if self.inexact else b"")
        out = [e or new.get(s) or fresh[s] for s, e in zip(segments, found, strict=True)]
        new.update((s, e) for s, e in fresh.items() if len(s) <= CACHE_CHARS)
        if len(new) > CACHE_SEGMENTS // 2:
            self._old, self._new = new, {}
        return out

    def spans(self, text: str) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """The text's segments as lookup() gives them, all ids, and the first and the past-the-last original byte of each id's span.

        Pieces follow each other through the normalised bytes; the pieces of a character that fell back to bytes share its span.
        """
        normal, source = self.aligned(text)
        found = self.lookup(self.segments.findall(normal))
        ids = np.frombuffer(b"".join([e[0] for e in found]), np.int32)
        step = np.frombuffer(b"".join([e[3] for e in found]), np.int32) if self.inexact else self.steps[ids]
        end = np.cumsum(step, dtype=np.int64)
        begin = end - step
        follows = self.follows[ids]
        if follows.any():
            begin = begin[np.maximum.accumulate(np.where(follows, 0, np.arange(len(ids))))]
        begin, end = source[begin], source[end]
        if self.end_id is not None:
            ids, begin, end = (np.append(x, v) for x, v in ((ids, np.int32(self.end_id)), (begin, source[-1]), (end, source[-1])))
        return found, ids, begin, end

    def digests(self, text: str | None) -> tuple[int, str, str, str]:
        """Number of ids with the end id; SHA-256 of the ids, of the decoded text, and of the spans (first and past-the-last byte of each id in turn, 32-bit little-endian)."""
        found, ids, begin, end = self.spans(text or "")
        shown = [e[1] for e in found] + ([b"%d" % self.end_id] if self.end_id is not None else [])
        decoded = self.finish(b"".join([e[2] for e in found]))
        spans = np.stack([begin, end], axis=1).astype("<i4").tobytes()
        return len(ids), *(hashlib.sha256(x).hexdigest() for x in (b" ".join(shown), decoded, spans))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with the end id, SHA-256 of the ids, SHA-256 of the decoded text."""
        return self.digests(text)[:3]

    def encode(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Ids with the end id, and the first and the past-the-last original byte of each piece's span.

        The pieces of a byte-fallback character share its span; the end id's span is empty.
        """
        _, ids, begin, end = self.spans(text or "")
        return ids.tolist(), begin.tolist(), end.tolist()

    # -- decoding -----------------------------------------------------------------------------

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The ids' text with its leading space still there; bytes that are not UTF-8 become U+FFFD each."""
        out, raw = bytearray(), bytearray()

        def flush():
            i = 0
            while i < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        raw[i : i + n].decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    out.extend(raw[i : i + n])
                    break
                else:
                    n = 1
                    out.extend("�".encode())
                i += n
            raw.clear()

        for k in ids:
            kind = self.types[k]
            if kind == BYTE:
                raw.append(int(self.pieces[k][3:5], 16))
                continue
            flush()
            if kind == UNKNOWN:
                out.extend(" ⁇ ".encode())
            elif kind != CONTROL:
                out.extend(self.pieces[k].replace(MARK, " ").encode("utf-8"))
        flush()
        return bytes(out)

    def finish(self, decoded: bytes) -> bytes:
        """decoded without the space that the dummy prefix brought."""
        if self.squeeze:
            return decoded.lstrip(b" ")
        return decoded[1:] if self.dummy_prefix and decoded.startswith(b" ") else decoded

    def decode(self, ids: Iterable[int]) -> str:
        return self.finish(self.decode_bytes(ids)).decode("utf-8")


def _model(path: str | None) -> PieceModel:
    """Read by the driver and sent along with the tasks: its size is that of one vocabulary file."""
    with open(path or default_model(), "rb") as f:
        return PieceModel(f.read())


def encode_documents(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids, and each piece's original byte span as two arrays, span_begin and span_end."""
    model = _model(model_path)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [model.encode(t) for t in b.column(1).to_pylist()]
            ints = lambda k: pa.array([r[k] for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ints(0), ints(1), ints(2)], names=[id_col, "ids", "span_begin", "span_end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(q(id_col), q(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, span_begin array<int>, span_end array<int>")


def decode_documents(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and the text its ids stand for (null ids: empty)."""
    model = _model(model_path)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def digest_documents(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 (of the pieces' original byte spans), in one pass that never holds a document's ids as rows."""
    model = _model(model_path)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [model.digests(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(q(id_col), q(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
