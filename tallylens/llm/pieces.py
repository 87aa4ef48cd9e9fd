"""SentencePiece models run by the tokenizers library.

The model file is a protobuf; its few fields are read here. From them the
normaliser (character map, white space rules, the dummy prefix), the white space
marker, the model (unigram scores, or merges by score) and byte fallback are
rebuilt. Batches of whole texts are encoded by several threads of one task.

``parity`` tells whether the SentencePiece library gives the same ids for the
whole text. ``round_trip`` tells whether decoding gives the text again (a text
that holds the marker itself, or is changed by the normaliser, does not). Null
text is an empty text and has no ids. The file is read on the driver by a path
parameter and broadcast (the size is checked).
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from tallylens.llm.tokens import cut

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_MODEL_BYTES = 64 << 20
MARK = "▁"
# kinds of pieces and models as numbered in the file format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and raw values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            size = varint() if size is None else size
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """What a model file says."""

    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    prefix: bool = True
    trim: bool = True
    escape: bool = True
    pieces: list[tuple[str, float, int]] = field(default_factory=list)


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            model.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(fields(value))
            model.kind, model.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            if own.get(24):
                raise ValueError("models with the marker behind words are not supported")
        elif number == 3:
            own = dict(fields(value))
            model.charsmap = own.get(2, b"")
            model.prefix, model.trim, model.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE) or any(kind == USER for _, _, kind in model.pieces):
        raise ValueError("only unigram and merge models without user-defined pieces are supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """All splits of every piece into two pieces, the better scored piece first."""
    scores = {p: s for p, s, kind in model.pieces if kind == NORMAL}
    found = [(-s, len(p[:i]), p[:i], p[i:]) for p, s in scores.items() for i in range(1, len(p)) if p[:i] in scores and p[i:] in scores]
    return [(a, b) for _, _, a, b in sorted(found, key=lambda x: x[:2])]


def normaliser(model: Model):
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK if model.escape else " ")] if model.prefix else []
    steps += [normalizers.Replace(" ", MARK)] if model.escape else []
    return normalizers.Sequence(steps)


def build(model: Model):
    """The model and the decoder as a tokenizer for normalised texts."""
    from tokenizers import Tokenizer, decoders, models

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), fuse_unk=True, byte_fallback=model.byte_fallback,
            unk_token=None if unknown is None else model.pieces[unknown][0])
    made = Tokenizer(core)
    made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return made


class Encoder:
    """Ids and decoded texts of batches."""

    def __init__(self, data: bytes):
        self.model = parse(data)
        self.normaliser, self.made = normaliser(self.model), build(self.model)
        self.plain = self.model.escape and not self.model.charsmap and not self.model.trim
        self.bytes = {i for i, (_, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        self.parts = [self.made.decode([i], skip_special_tokens=False) for i in range(len(self.model.pieces))]

    def normalised(self, text: str) -> str:
        if not self.plain:
            return self.normaliser.normalize_str(text)
        return (MARK if self.model.prefix and text else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.made.encode_batch_fast([self.normalised(t) for t in texts], add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        """Only bytes of one character need their neighbours; else the pieces' own texts are set side by side."""
        if self.bytes.isdisjoint(ids):
            text = "".join(map(self.parts.__getitem__, ids))
        else:
            text = self.made.decode(ids, skip_special_tokens=False)
        return text.removeprefix(" ") if self.model.prefix else text


def read_model(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; at most {MOST_MODEL_BYTES} are broadcast")
    return data


def encode(docs: DataFrame, path: str = MODEL, threads: int = 2) -> DataFrame:
    """All columns of ``docs`` and ``ids``, ``n_tokens``, ``parity``, ``round_trip``; input columns of these names are
    replaced."""
    docs = docs.drop("ids", "n_tokens", "parity", "round_trip")
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        import sentencepiece

        encoder, library = Encoder(model.value), sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for batch in batches:
            for at, part in cut(batch["text"], 1 << 20):
                texts = part.to_pylist()
                ids = encoder.encode(texts)
                same = [a == b for a, b in zip(ids, library.encode(texts), strict=True)]
                added = [
                    pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_()),
                    pa.array([encoder.decode(i) == t for i, t in zip(ids, texts, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, len(part)).columns, *added], [*batch.schema.names, "ids", "n_tokens", "parity", "round_trip"])

    return docs.mapInArrow(run, StructType([
        *docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()),
        StructField("parity", BooleanType()), StructField("round_trip", BooleanType())]))
