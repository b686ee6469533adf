"""Binary save files: big-endian records with length-prefixed UTF-16 strings and counted lists."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class Reader:
    """A cursor over the bytes of one file."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def _take(self, form: str):
        (value,) = struct.unpack_from(f">{form}", self.data, self.at)
        self.at += struct.calcsize(f">{form}")
        return value

    def u1(self) -> int:
        return self._take("B")

    def u2(self) -> int:
        return self._take("H")

    def s4(self) -> int:
        return self._take("i")

    def u4(self) -> int:
        return self._take("I")

    def f8(self) -> float:
        return self._take("d")

    def string(self) -> str | None:
        """Four bytes of length and as many of UTF-16; -1 is no string."""
        n = self.s4()
        if n < 0:
            return None
        if self.at + n > len(self.data):
            raise ValueError("a string runs past the end")
        text = self.data[self.at : self.at + n].decode("utf-16-be")
        self.at += n
        return text

    def items(self, read: Callable[[Reader], object]) -> list:
        return [read(self) for _ in range(self.s4())]


def names(reader: Reader) -> list[dict]:
    """A list of names, each an id and a string."""
    return reader.items(lambda r: {"id": r.s4(), "name": r.string()})


def read_records(spark: SparkSession, path: str, decode: Callable[[Reader], list[dict]], schema: str) -> DataFrame:
    """The records that ``decode`` finds in each file, a file a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(decode(Reader(bytes(content))))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
