"""Wave files: the header as an expression, and a writer as a Spark data source."""

from __future__ import annotations

import struct
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _little(value: Column, size: int) -> Column:
    text = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(text, 2 * (size - i) - 1, 2) for i in range(size)])


def header(samples: Column, rate: Column, channels: Column) -> Column:
    """The 44 bytes before 16-bit interleaved samples (their number over all channels)."""
    data = samples.cast("long") * 2
    hexed = F.concat(
        F.hex(F.lit("RIFF")), _little(data + 36, 4), F.hex(F.lit("WAVEfmt ")), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(channels, 2),
        _little(rate, 4), _little(rate.cast("long") * channels * 2, 4), _little(channels * 2, 2), _little(F.lit(16), 2), F.hex(F.lit("data")), _little(data, 4),
    )
    return F.unhex(hexed)


def header_bytes(samples: int, rate: int, channels: int) -> bytes:
    return struct.pack("<4sI8sIHHIIHH4sI", b"RIFF", 36 + 2 * samples, b"WAVEfmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", 2 * samples)


class WavDataSource(DataSource):
    """df.write.format("wav").save(uri): one file for each row (name, sample_rate_hz, channels, pcm16).

    Files appear under temporary names and are renamed when the whole write commits."""

    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return "name string, sample_rate_hz int, channels int, pcm16 array<smallint>"

    def writer(self, schema, overwrite):
        return WavWriter(self.options["path"])


class Written(WriterCommitMessage):
    def __init__(self, names):
        self.names = names


class WavWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def _fs(self):
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri else (pafs.LocalFileSystem(), self.uri)

    def write(self, iterator):
        fs, base = self._fs()
        fs.create_dir(base, recursive=True)
        names = []
        for row in iterator:
            samples = struct.pack(f"<{len(row.pcm16)}h", *row.pcm16)
            temp = f"{base}/_{row.name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as out:
                out.write(header_bytes(len(row.pcm16), row.sample_rate_hz, row.channels) + samples)
            names.append((temp, f"{base}/{row.name}.wav"))
        return Written(names)

    def commit(self, messages):
        fs, _ = self._fs()
        for message in messages:
            for temp, name in message.names:
                fs.move(temp, name)

    def abort(self, messages):
        fs, _ = self._fs()
        for message in messages:
            for temp, _ in message.names if message else []:
                fs.delete_file(temp)
