"""URL filter: rules for hosts and paths first, logistic regression on hashed character n-grams for the rest.

The regression reads n-grams of the host and of the path, each in its own hash space, and is trained on the driver from a
small labelled URL table (``labelled()`` unless another is given; its size is the caller's bound, and memory is in proportion to its
letters). Urls are judged with one pass and no shuffle; n-grams of a batch are hashed and weighed together, and only those of urls that no rule decides.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the model; equal urls get equal
verdicts; a url of any length is read whole; ``block_score`` is null where a rule decides; without any labelled url every score is 0; an empty
table gives no rows; other columns pass through, and those named as one of the results get underscores before their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free_name, make_room
from .line_dedup import ascii_lower

ALLOW, BLOCK = "allow", "block"

# Words of the labelled table; the table itself is made by the rule in ``labelled``.
SPAM_HOSTS = """
casino poker slots jackpot betting bets roulette lottery bingo gamble pills pharma viagra tablets diet slim adult xxx porn cams escort
hookup singles sexy loan payday cash debt forex crypto doubler replica fake cheap discount bonus prize win winner free spam seo backlinks
links farm ads advert track tracker click popup banner redirect torrent warez crack keygen serial hacked phish malware
""".split()
SPAM_PATHS = "buy-now claim-prize free-spins no-prescription instant-cash win-big hot-singles live-cams get-rich download-crack click-here limited-offer".split()
PLAIN_HOSTS = """
docs library news blog university wiki health museum recipes weather journal garden travel forum code archive school city music books
radio maps cycling chess science history geography theatre gallery kitchen harbour valley mountain river forest island bakery village
railway bridge castle market weaver potter carpenter teacher student doctor nurse engineer painter writer reader singer runner swimmer
anderson martinez schneider rossi dubois novak silva tanaka okafor larsen thornton whitfield bretton eastern northern southern western
theory thread threshold station nation motion question creation tradition another weather whether together further within without
english polish spanish fresh wish bush marsh table cable stable noble fable format habitat combat wheat great coast forest artist honest post
student talent ancient moment giant plant garden wooden golden silver timber winter summer corner border letter paper water morning evening
building reading spring string bread field cloud sound ground south north mouth month truth health earth cloth moth fifth math bath path
""".split()
PLAIN_PATHS = "guide/install articles/printing science/comet posts/bread courses/algebra topics/reading reviews/quartet notes/evening about contact index/letters".split()
FRONTS, ENDS, LANGS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org"), ("en", "de", "fr", "es")


def labelled() -> list[tuple[str, str]]:
    """(verdict, url) of the default table: words in pairs as hosts, with paths that say nothing (a language and a number) or something."""
    out = []
    for verdict, words, paths in ((BLOCK, SPAM_HOSTS, SPAM_PATHS), (ALLOW, PLAIN_HOSTS, PLAIN_PATHS)):
        for i, w in enumerate(words):
            for j in range(4):
                other = words[(i + 7 * j + 3) % len(words)]
                name = (f"{w}-{other}", w, f"{w}{other}", f"{other}{i}")[j] if verdict == ALLOW else (f"{w}-{other}", f"{other}-{w}", f"{w}{other}", f"{w}{i}")[j]
                plain = f"{LANGS[(i + j) % 4]}/{(i * 397 + j * 1013) % 9000 + 1000}{('', '/', '.html')[(i + j) % 3]}"
                path = plain if j % 2 == 0 else paths[(i + j) % len(paths)]
                out.append((verdict, f"https://{FRONTS[(i + j) % 4]}{name}.{ENDS[(i + j) % 3]}/{path}"))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def split_url(url: str) -> tuple[str, str]:
    """The same for one string."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def rule_columns(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, or nulls. rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is asked first: it comes last here
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


#: Factor of the n-gram hash and the shift that mixes it.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Model:
    """Logistic regression on hashed character n-grams; full-batch gradient descent with L2, from zero: no chance in it."""

    def __init__(self, table: list[tuple[str, str]], bits: int = 18, sizes: tuple[int, ...] = (3, 4, 5), rounds: int = 400, rate: float = 4.0, l2: float = 1e-4):
        self.bits, self.sizes = bits, sizes
        self.weights, self.bias = np.zeros(1 << bits), 0.0 if table else -np.inf
        if not table:
            return
        row, gram = self.grams(*zip(*(split_url(u) for _, u in table), strict=True))
        used, column = np.unique(gram, return_inverse=True)
        n, y = len(table), np.array([float(v == BLOCK) for v, _ in table])
        share = (1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n))))[row]
        # Both verdicts weigh the same, however many urls have each.
        w, evenly = np.zeros(len(used)), np.where(y > 0, 0.5 * n / max(1, y.sum()), 0.5 * n / max(1, n - y.sum()))
        for _ in range(rounds):
            off = evenly * (1 / (1 + np.exp(-(np.bincount(row, weights=w[column] * share, minlength=n) + self.bias))) - y)
            w -= rate * (np.bincount(column, weights=off[row] * share, minlength=len(used)) / n + l2 * w)
            self.bias -= rate * float(off.mean())
        self.weights[used] = w

    def grams(self, hosts, paths) -> tuple[np.ndarray, np.ndarray]:
        """(row, hashed n-gram) of all n-grams of urls, host and path in hash spaces of their own, with marks at their ends."""
        rows, grams = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for space, parts in enumerate((hosts, paths)):
            data = [f"^{s}$".encode() for s in parts]
            b = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
            size = np.array([len(d) for d in data], dtype=np.int64)
            owner, left = np.repeat(np.arange(len(data)), size), np.repeat(np.cumsum(size), size) - np.arange(len(b))
            h = np.full(len(b), np.uint64(space))
            for n in range(1, max(self.sizes) + 1):
                if len(b) < n:
                    break
                h = (h[: len(b) - n + 1] ^ b[n - 1 :]) * FACTOR
                h ^= h >> np.uint64(29)
                if n in self.sizes:
                    inside = left[: len(h)] >= n
                    rows.append(owner[: len(h)][inside])
                    grams.append(((h[inside] * FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64))
        return np.concatenate(rows), np.concatenate(grams)

    def scores(self, hosts, paths) -> np.ndarray:
        """Probability that each url is to be blocked."""
        row, gram = self.grams(hosts, paths)
        total = np.bincount(row, weights=self.weights[gram], minlength=len(hosts)) / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(hosts))))
        return 1 / (1 + np.exp(-(total + self.bias)))


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", table: list[tuple[str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """``df`` with host, path, rule, block_score (the model's, where no rule decides) and verdict."""
    df, moved = make_room(df, "host", "path", "rule", "block_score", "verdict")
    url = moved.get(url, url)
    model = Model(labelled() if table is None else table)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        out, open_ = pd.Series(np.nan, index=host.index, dtype="float64"), host.notna().to_numpy()
        for k in range(0, int(open_.sum()), 1024):
            some = np.flatnonzero(open_)[k : k + 1024]
            out.iloc[some] = model.scores(host.iloc[some].tolist(), path.iloc[some].tolist())
        return out

    ruled = free_name("_ruled", df.columns)
    host, path = host_and_path(F.col(url))
    x = df.withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    x = x.withColumns({"rule": rule, ruled: verdict})
    free = F.col("rule").isNull()
    x = x.withColumn("block_score", F.nanvl(score(F.when(free, F.col("host")), F.when(free, F.col("path"))), F.lit(None).cast("double")))
    x = x.withColumn("verdict", F.coalesce(ruled, F.when(F.col("block_score") >= threshold, BLOCK).otherwise(ALLOW)))
    return x.drop(ruled)
