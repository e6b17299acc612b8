"""Sequences from the NCBI efetch service: a client on the driver, as its quota doesn't allow fan-out.

At most 3 requests in any second, 10 with a key. Answers are kept by id where a cache folder is given.
"""

from __future__ import annotations

import os
import time
import urllib.parse
import urllib.request
from collections import deque
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from . import io

URL = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"


class Entrez:
    def __init__(self, path: str | None = None, api_key: str | None = None, get: Callable[[str], str] | None = None):
        self.path, self.api_key = path, api_key
        self.limit = 10 if api_key else 3
        self.times: deque[float] = deque()
        self.get = get or self._get

    @staticmethod
    def _get(url: str) -> str:
        with urllib.request.urlopen(url, timeout=60) as answer:
            return answer.read().decode()

    def _wait(self) -> None:
        now = time.monotonic()
        while self.times and now - self.times[0] >= 1:
            self.times.popleft()
        if len(self.times) >= self.limit:
            time.sleep(max(0.0, 1 - (now - self.times[0])))
            self.times.popleft()
        self.times.append(time.monotonic())

    def fetch_seq(self, seqid: str, rettype: str = "gb", db: str = "nuccore", overwrite: bool = False) -> str:
        """The record's text, from the cache folder if it is there."""
        place = os.path.join(self.path, f"{urllib.parse.quote(seqid, safe='')}.{rettype}") if self.path else None
        if place and os.path.exists(place) and not overwrite:
            with open(place, encoding="utf-8") as file:
                return file.read()
        self._wait()
        query = {"db": db, "id": seqid, "rettype": rettype, "retmode": "text"} | ({"api_key": self.api_key} if self.api_key else {})
        text = self.get(f"{URL}?{urllib.parse.urlencode(query)}")
        if place:
            os.makedirs(self.path, exist_ok=True)
            with open(place, "w", encoding="utf-8") as file:
                file.write(text)
        return text

    def fetch_basket(self, seqids: Sequence[str], **options) -> list[str]:
        return [self.fetch_seq(i, **options) for i in seqids]

    def get_basket(self, spark: SparkSession, seqids: Sequence[str], rettype: str = "gb", **options) -> DataFrame:
        """The records as sequences, in the order of the ids."""
        fmt = {"gb": "genbank", "fasta": "fasta", "embl": "embl"}[rettype]
        return io.from_string(spark, "\n".join(self.fetch_basket(seqids, rettype=rettype, **options)), fmt)

    def get_seq(self, spark: SparkSession, seqid: str, **options) -> DataFrame:
        return self.get_basket(spark, [seqid], **options)
