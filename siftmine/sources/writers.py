"""Report formats. Large results go out with DataFrame.write; these are for results that a person reads."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_report(df: DataFrame) -> DataFrame:
    """One row with a one-element array of the object, as text."""
    return df.select(F.concat(F.lit("["), F.to_json(F.struct("*")), F.lit("]")).alias("value"))


def delimited(df: DataFrame, path: str, header: str, separator: str = ", ", line: str = "\n") -> None:
    """Ordered rows with a header and a separator of any length, one part after another; values that hold the separator are quoted."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(header + line)
        for row in df.toLocalIterator():
            f.write(separator.join(_field(v, separator) for v in row) + line)


def _field(v, separator: str) -> str:
    s = "" if v is None else str(v)
    return '"' + s.replace('"', '""') + '"' if separator.strip() in s or '"' in s else s


def city_csv(df: DataFrame, path: str) -> None:
    """city,stars with CRLF."""
    delimited(df, path, "city,stars", ",", "\r\n")


def similarity_csv(df: DataFrame, path: str) -> None:
    delimited(df, path, "business_id_1, business_id_2, similarity")


def prediction_csv(df: DataFrame, path: str) -> None:
    delimited(df, path, "user_id, business_id, prediction")


def itemset_lines(sets: Iterable[tuple[str, ...]]) -> str:
    """One line for each size, smallest first; singles as ('a'), larger ones as tuples."""
    by_size: dict[int, list[tuple[str, ...]]] = {}
    for s in sets:
        by_size.setdefault(len(s), []).append(tuple(sorted(s)))
    said = lambda s: f"('{s[0]}')" if len(s) == 1 else str(s)
    return "\n\n".join(", ".join(map(said, sorted(by_size[n]))) for n in sorted(by_size))


def itemset_report(candidates: Iterable[tuple[str, ...]], frequent: Iterable[tuple[str, ...]], path: str) -> None:
    Path(path).write_text(f"Candidates:\n{itemset_lines(candidates)}\n\nFrequent Itemsets:\n{itemset_lines(frequent)}", encoding="utf-8")


def community_lines(df: DataFrame, path: str) -> None:
    """Quoted members, a community a line, of ordered rows with `members`."""
    lines = df.select(F.array_join(F.transform("members", lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", ").alias("line"))
    Path(path).write_text("\n".join(r["line"] for r in lines.toLocalIterator()) + "\n", encoding="utf-8")


def betweenness_lines(df: DataFrame, path: str) -> None:
    """('a', 'b'), value by ordered rows (a, b, value)."""
    Path(path).write_text("\n".join(f"('{r['a']}', '{r['b']}'), {r['value']}" for r in df.toLocalIterator()) + "\n", encoding="utf-8")


def bfr_report(rounds: DataFrame, clusters: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("The intermediate results:\n")
        for r in rounds.orderBy("round").toLocalIterator():
            f.write(f"Round {r['round']}: {r['n_ds']},{r['n_cs_clusters']},{r['n_cs']},{r['n_rs']}\n")
        f.write("\nThe clustering results:\n")
        for r in clusters.orderBy("id").toLocalIterator():
            f.write(f"{r['id']},{r['cluster']}\n")


def append_line(path: str, header: str, values: Iterable) -> None:
    """A line of a streaming report; the header comes with the first."""
    p = Path(path)
    new = not p.exists()
    with p.open("a", encoding="utf-8") as f:
        if new:
            f.write(header + "\n")
        f.write(",".join(map(str, values)) + "\n")


def console(title: str, value) -> str:
    text = f"{title}: {value if isinstance(value, str) else json.dumps(value)}"
    print(text)
    return text
