"""Media columns: texts stored as audio, with its features as fixed-shape tensors and time spans.

store_audio() turns each text into a WAV file (mono, unsigned 8-bit samples at
12 kHz, so nothing is lost) and analyses it: polyphase resampling to 8 kHz,
overlapping 25 ms frames every 10 ms, 32 log-mel bands, and hysteresis
segmentation of the energy. A row has the WAV bytes, the filterbanks as an Arrow
IPC stream of fixed-shape tensors of (64, 32) float16 values with the time span
of each (read_tensors() gives them back), and the segments with their spans.
The query writes this table to the shared folder, reads it back, and takes all
its digests from what it reads. audio_tensors() gives a row for each tensor,
speech_segments() one for each segment.

Null texts count as empty; the payload has 64 zero bytes then, which make one
frame. Long texts are analysed in blocks of frames. Equal texts have equal
values, repeated rows each have their row, rows with a null doc_id too. Other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio_core as audio
from .common import groups_of, materialise, read_table, text_bytes

STORED = "doc_id long, n_bytes long, media binary, frames int, tensors binary, segments array<struct<begin_s:double,end_s:double>>"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: What the tensors column of a row holds, as an Arrow IPC stream.
TENSOR = pa.fixed_shape_tensor(pa.float16(), [audio.PATCH, audio.MELS], dim_names=["frame", "mel"])
TENSORS = pa.schema([("mel", TENSOR), ("begin_s", pa.float64()), ("end_s", pa.float64())])
_SPANS = pa.list_(pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64())]))


def write_tensors(found: audio.Features) -> bytes:
    """The filterbanks in patches, as an Arrow IPC stream of TENSORS."""
    spans = found.patch_spans()
    values = pa.array(found.patches(np.float16).reshape(-1))
    mel = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(values, audio.PATCH * audio.MELS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSORS) as out:
        out.write_batch(pa.record_batch([mel, pa.array([a for a, _ in spans]), pa.array([b for _, b in spans])], schema=TENSORS))
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    """The table (mel: fixed-shape tensor, begin_s, end_s) that write_tensors() made."""
    with pa.ipc.open_stream(data) as stream:
        return stream.read_all()


def filterbanks(tensors: pa.Table, frames: int) -> np.ndarray:
    """(frames, MELS): the patches put together, without what fills up the last one."""
    return tensors["mel"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)[:frames].astype(np.float32)


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, frames, tensors, segments): every row's text as a WAV file, with its features."""
    names = ["doc_id", "n_bytes", "media", "frames", "tensors", "segments"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in groups_of(texts):
                media = [audio.wav(audio.payload(x)) for x in texts[a:b]]
                found = [audio.analyse(x) for x in media]
                columns = [
                    pa.array([len(x or b"") for x in texts[a:b]], pa.int64()),
                    pa.array(media, pa.binary()),
                    pa.array([len(x.mel) for x in found], pa.int32()),
                    pa.array([write_tensors(x) for x in found], pa.binary()),
                    pa.array([[{"begin_s": s, "end_s": e} for s, e in x.spans] for x in found], _SPANS),
                ]
                yield pa.record_batch([batch.column(0).slice(a, b - a), *columns], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, STORED)


def audio_features(stored: DataFrame) -> DataFrame:
    """Digests of the stored bytes and of the stored features: see op10."""
    schema = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for media, frames, tensors, spans in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                data = media.as_py()
                _, samples = audio.read_wav(data)
                mel = filterbanks(read_tensors(tensors.as_py()), frames.as_py())
                seconds = [(x["begin_s"], x["end_s"]) for x in spans.as_py()]
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), audio.digest(mel, seconds)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", *schema])

    return stored.mapInArrow(run, DIGESTS)


def audio_tensors(stored: DataFrame) -> DataFrame:
    """(doc_id, patch, begin_s, end_s, mel array<float> of PATCH * MELS values, row by row): the stored tensors in time order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = read_tensors(data.as_py()).combine_chunks()
                n = got.num_rows
                mel = got["mel"].combine_chunks().storage.cast(pa.list_(pa.float32()))
                yield pa.record_batch([pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), *(got[c].combine_chunks() for c in ("begin_s", "end_s")), mel], names=["doc_id", "patch", "begin_s", "end_s", "mel"])

    return stored.select("doc_id", "tensors").mapInArrow(run, "doc_id long, patch int, begin_s double, end_s double, mel array<float>")


def speech_segments(stored: DataFrame) -> DataFrame:
    """(doc_id, begin_s, end_s) of the segments with energy."""
    return stored.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.begin_s", "s.end_s")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document, from the written table."""
    stored, _ = materialise(spark, store_audio(read_table(spark, sf_dir, "documents")), "media", "zstd")
    return audio_features(stored)
