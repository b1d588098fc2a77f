"""Ordered lists of generated answers: numbers that go on across explanations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = re.compile(r"^(\s*)(\d+)\.\s+(.+)$")
HEADING = re.compile(r"^(?:#{1,6}\s+|[一二三四五六七八九十百]+[、．.：:]\s*)")


def renumbered(text: str) -> str:
    """Items of an indent get rising numbers until a heading, a fence or a shallower item; after other lines an item shows `n、`."""
    out, fenced = [], False
    levels: list[list[int]] = []  # [indent, last number, line of its last item], deeper ones last
    others = -1  # the last line that was no item
    for n, line in enumerate(text.split("\n")):
        bare = line.strip()
        fence = bare.startswith("```")
        item = None if fence or fenced else ITEM.match(line)
        if fence or (not fenced and HEADING.match(bare)):
            fenced ^= fence
            levels = []
        elif item:
            indent, number = len(item[1].replace("\t", "    ")), int(item[2])
            while levels and levels[-1][0] > indent:
                levels.pop()
            if levels and levels[-1][0] == indent:
                last, at = levels[-1][1:]
                shown = max(number, last + 1)
                if others > at:
                    line = f"{item[1]}{shown}、 {item[3]}"
                elif shown != number:
                    line = f"{item[1]}{shown}. {item[3]}"
                levels[-1] = [indent, shown, n]
            else:
                levels.append([indent, number, n])
        elif not fenced:
            others = n
        out.append(line)
    return "\n".join(out)


def lists_repaired(text: Column) -> Column:
    """Null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(renumbered, na_action="ignore")

    return run(text)
