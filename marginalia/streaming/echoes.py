"""Generated text up to where it repeats itself or its context, in a batch and over a stream of fragments.

A sentence is whatever comes before a run of end marks, with the run; it is whole when something else follows, so that
where fragments are cut changes nothing. Sentences are compared without white space. The first that stands in the
context or earlier ends the output; a last piece without an end mark is given unless it stands there too. Blank pieces
repeat nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The marks that end a sentence.
MARKS = "。．.！？!?\n"
PIECES = rf"((?s).*?[{MARKS}]+|.+\z)"
_WHOLE = re.compile(rf"(?s).*?[{MARKS}]+(?=[^{MARKS}])")
_SPACE = re.compile(r"\s+")


def _keys(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(1)), lambda s: F.regexp_replace(s, r"\s+", ""))


def without_echo(context: Column, text: Column) -> Column:
    """The part of text before its first echo; null for a null text."""
    known = F.transform(_keys(F.coalesce(context, F.lit(""))), lambda k: F.struct(k.alias("key"), F.lit(-1).alias("at")))
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(1))
    own = F.transform(_keys(text), lambda k, i: F.struct(k.alias("key"), i.alias("at")))
    # held in a struct, so that the sort is done once for a text
    both = F.array(F.struct(pieces.alias("pieces"), F.array_sort(F.concat(known, own)).alias("keys")))

    def cut(z: Column) -> Column:
        echoes = F.filter(z["keys"], lambda x, j: (x["at"] >= 0) & (x["key"] != "") & (j > 0) & (F.get(z["keys"], j - 1)["key"] == x["key"]))
        first = F.coalesce(F.array_min(F.transform(echoes, lambda x: x["at"])), F.size(z["pieces"]))
        return F.array_join(F.slice(z["pieces"], F.lit(1), first), "")

    return F.get(F.transform(both, cut), 0)


class Echoes(StatefulProcessor):
    """Fragments (at, text, last) of one text to the sentences that are whole by now and echo nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "text string, next long, stopped boolean")
        self.waiting = handle.getMapState("waiting", "at long", "text string, last boolean")
        self.seen = handle.getMapState("seen", "key string", "yes boolean")

    def _echoes(self, piece: str) -> bool:
        key = _SPACE.sub("", piece)
        if not key:
            return False
        if self.seen.containsKey((key,)):
            return True
        self.seen.updateValue((key,), (True,))
        return False

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        text, following, stopped = self.pending.get() if self.pending.exists() else ("", 0, False)
        for batch in rows:
            for at, piece, context, last in zip(batch["at"], batch["text"], batch["context"], batch["last"], strict=True):
                if context is not None:
                    for k in re.findall(rf"(?s).*?[{MARKS}]+|.+\Z", context):
                        self._echoes(k)
                self.waiting.updateValue((int(at),), (piece or "", bool(last)))
        out = []
        while self.waiting.containsKey((following,)):  # fragments may come in any order
            piece, last = self.waiting.getValue((following,))
            self.waiting.removeKey((following,))
            text, following = text + piece, following + 1
            while not stopped and (whole := _WHOLE.match(text)):
                stopped = self._echoes(whole[0])
                if not stopped:
                    out.append(whole[0])
                text = text[whole.end() :]
            if last and not stopped and text and not self._echoes(text):
                out.append(text)
                stopped = True
        self.pending.update(("" if stopped else text, following, stopped))
        if out:
            yield pd.DataFrame({"id": [key[0]], "text": ["".join(out)]})

    def close(self) -> None:
        pass


def echoes_cut(fragments: DataFrame) -> DataFrame:
    """(id, text) as it becomes known, of a stream of fragments (id, at, text, context, last): numbered from 0, the first
    with the context. Needs the state store of jobs.with_store()."""
    rows = fragments.select(F.col("id").cast("string").alias("id"), F.col("at").cast("long").alias("at"), "text", "context", "last")
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=Echoes(), outputStructType="id string, text string", outputMode="append", timeMode="none")
