"""Small documents with every awkward case, and brute-force versions of what SQL cannot express."""

from __future__ import annotations

import random
import re
import string

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORDS = [a + b + c for a in ("ba", "do", "ki", "lu", "me", "né") for b in ("ra", "to", "vi", "su") for c in ("n", "s", "l", "mok")]


def text(seed: int, n: int, line: int = 12) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]
    return "\n".join(" ".join(words[i:i + line]) + "." for i in range(0, n, line))


def documents() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and blank texts, repeated rows, exact and near copies, one long text."""
    base = text(1, 150)
    near = base.split(" ")
    near[30], near[90] = "changed", "other"
    rows = [(1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, text(2, 60), "a"), (4, text(2, 60), "a"), (5, "", "a"), (6, " \n\t ", None), (7, None, "b"), (8, "one", "a"), (9, "İé Ünï ÀB ab", "b")]
    rows += [(100 + k, text(100 + k, 40 + 7 * k), f"s{k % 3}") for k in range(25)]
    rows += [(200, text(9, 6000), "a"), (None, text(3, 50), "a"), (201, "same line\n" * 30 + text(5, 30), "b")]
    return rows


def frame(spark, rows=None, schema: str = "doc_id long, text string, source string"):
    """The documents, with columns whose names operators use themselves."""
    df = spark.createDataFrame(documents() if rows is None else rows, schema)
    for name in ("unit", "key", "_row", "label", "score", "size", "class"):
        df = df.selectExpr("*", f"1 AS `{name}`")
    return df


def split(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def alnum(t: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def roots(n: int, links) -> list[int]:
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
