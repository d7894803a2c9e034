"""URL filter: rules by host and path first, then a logistic model of hashed character n-grams.

The model sees host and path apart. Each n-gram is hashed into a fixed number
of slots; a URL's values are weighted counts over their norm, and those of the
path weigh less. It is fitted
to a small table of labelled URLs by plain gradient steps, and tasks receive
its weights, a vector of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import batches, byte_values, mix, text_bytes, text_slices, windows
from tidemark.staging import literal_table, stage

SLOT_BITS = 18
SIZES = (3, 4, 5)
PATH_WEIGHT = 0.3
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

#: Default labelled table: 1 for sites that a text corpus does without.
LABELLED = [
    *[(f"https://{host}{path}", 1) for host, path in [
        ("www.casino-royal-slots.com", "/play/now"), ("best-casino.net", "/bonus?id=3"), ("casinowin24.org", "/jackpot"), ("m.win-big-casino.com", "/"),
        ("free-bets-online.com", "/odds/12"), ("sport-bets.net", "/live"), ("bets365free.org", "/en/7"), ("www.poker-bet.com", "/table"),
        ("cheap-viagra-pills.net", "/order"), ("buy-pills-online.com", "/en/55"), ("pills4cheap.org", "/shop.html"), ("blog.cheap-meds.com", "/de/3"),
        ("adult-video-x.com", "/watch/99"), ("xxx-adult.net", "/fr/12"), ("www.adult-cams.org", "/live"), ("hot-adult-chat.com", "/join"),
        ("spamlinks.info", "/a/b/c"), ("linkfarm-spam.net", "/en/1"), ("seo-link-farm.com", "/en/884"), ("spam-blog-farm.org", "/post"),
        ("ads-tracker.net", "/pixel?x=1"), ("track-ads.com", "/click"), ("adserver-track.org", "/t/12"), ("m.popup-ads.net", "/go"),
        ("payday-loans-fast.com", "/apply"), ("replica-watches-cheap.net", "/sale"), ("free-ringtones-win.com", "/get"), ("win-free-phone.org", "/claim"),
        ("www.cheap-loans.example.com", "/en/640"), ("blog.casino-bonus.example.net", "/de/12.html"), ("m.adult-clips.example.org", "/fr/92"),
        ("ads-popup.example.com", "/es/3#top"), ("spam-host.example.net", "/en/77?page=2"), ("best-bets.example.org", "/en/9"),
        ("blog.pills-shop.example.com", "/en/31/"), ("www.click-track.example.net", "/en/5?utm_source=feed"), ("win-cash.example.com", "/fr/8.html"),
        ("m.link-farm.example.org", "/de/615"), ("free-slots.example.net", "/es/44"), ("blog.cheap-bags.example.com", "/en/208"),
    ]],
    *[(f"https://{host}{path}", 0) for host, path in [
        ("www.example.org", "/en/12"), ("blog.example.com", "/fr/733.html"), ("m.example.net", "/de/48/"), ("example.com", "/es/5?page=2"),
        ("en.wikipedia.org", "/wiki/Graph_theory"), ("docs.python.org", "/3/library/os.html"), ("www.nature.com", "/articles/s41586"),
        ("news.bbc.co.uk", "/science/2004"), ("www.gutenberg.org", "/files/1342"), ("arxiv.org", "/abs/1706.03762"),
        ("www.theguardian.com", "/books/2019/review"), ("stackoverflow.com", "/questions/11227809"), ("github.com", "/apache/spark"),
        ("www.lemonde.fr", "/planete/article/2020"), ("www.spiegel.de", "/kultur/literatur"), ("elpais.com", "/cultura/2021"),
        ("spark.apache.org", "/docs/latest"), ("www.who.int", "/news-room"), ("europa.eu", "/european-union/index_en"),
        ("www.mit.edu", "/research"), ("ocw.mit.edu", "/courses/mathematics"), ("www.loc.gov", "/collections"),
        ("blog.mozilla.org", "/en/privacy"), ("www.w3.org", "/TR/html52"), ("archive.org", "/details/texts"), ("www.reuters.com", "/world/en/24"),
        ("therin.example.net", "/en/770#top"), ("m.garden.example.org", "/es/61"), ("www.history.example.com", "/en/9"), ("blog.kitchen.example.net", "/fr/310?page=2"),
        ("northern.example.com", "/de/77.html"), ("blog.other-side.example.org", "/en/18"), ("m.tion.example.net", "/en/404?utm_source=feed"), ("www.nationalgeographic.com", "/history/article"), ("blog.thornton.example.com", "/en/853/"), ("kids.britannica.com", "/students/en/9"),
    ]],
]


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without it."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rules(urls: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest rule that fits each row; ``urls`` has row, host, path.

    A rule is a host and the start of a path; it fits the host and all its
    subdomains. Each row looks up the ends of its host among the rules, so the
    cost does not grow with their number.
    """
    spark = urls.sparkSession
    table = rules if isinstance(rules, DataFrame) else literal_table(spark, rules, ["rule", "rule_verdict"])
    slash = F.instr("rule", "/")
    table = table.select(
        "rule", "rule_verdict", F.substring("rule", F.lit(1), slash - 1).alias("suffix"), F.substring("rule", slash, F.length("rule")).alias("start")
    )
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = urls.select("row", "path", F.explode(ends).alias("suffix")).join(table, "suffix").filter(F.startswith("path", "start"))
    best = tried.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "rule_verdict")).alias("best"))
    return urls.join(best.select("row", "best.rule", "best.rule_verdict"), "row", "left")


def _slots(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of every n-gram; the values of a row have norm 1."""
    rows, slots, values = [], [], []
    for part, column in enumerate((hosts, paths)):
        data, offsets = text_bytes(column)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for size in SIZES:
            grams = windows(byte_values(data), size)
            inside = owner[: len(grams)] == owner[size - 1 :][: len(grams)]
            rows.append(owner[: len(grams)][inside])
            slots.append((mix(grams[inside] + np.uint64(97 * part + size)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
            values.append(np.full(len(rows[-1]), PATH_WEIGHT if part else 1.0))
    row, value = np.concatenate(rows), np.concatenate(values)
    norm = np.sqrt(np.bincount(row, value**2, len(hosts)))
    return row, np.concatenate(slots), value / norm[row]


def _scores(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, count: int, weights: np.ndarray, base: float) -> np.ndarray:
    sums = np.bincount(rows, weights[slots] * values, count) + base
    return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))


def _parts(urls: list[str | None]) -> tuple[pa.Array, pa.Array]:
    hosts, paths = [], []
    for url in urls:
        _, mark, rest = (url or "").partition("://")
        rest = rest.split("#")[0].split("?")[0] if mark else ""
        host, slash, path = rest.partition("/")
        hosts.append(host.lower())
        paths.append(slash + path)
    return pa.array(hosts, pa.string()), pa.array(paths, pa.string())


def fit(labelled: list[tuple[str, int]], steps: int = 400, rate: float = 2.0, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weight per slot, constant) of the logistic model."""
    weights, base = np.zeros(1 << SLOT_BITS), 0.0
    truth = np.array([label for _, label in labelled], float)
    if not len(truth):
        return weights, base
    rows, slots, values = _slots(*_parts([url for url, _ in labelled]))
    for _ in range(steps):
        error = truth - _scores(rows, slots, values, len(truth), weights, base)
        weights += rate * (np.bincount(slots, error[rows] * values, len(weights)) / len(truth) * 10 - shrink * weights)
        base += rate * error.mean()
    return weights, base


def judge(pages: DataFrame, rules=RULES, labelled: list[tuple[str, int]] = LABELLED, threshold: float = 0.5) -> DataFrame:
    """Per input row: page_id, url, host, path, rule, score, verdict.

    The longest fitting rule decides; without one the model does, from
    ``threshold`` on with block. Needs page_id and url; other columns are
    ignored. A NULL url, or one without ://, has an empty host and path, fits no
    rule and is judged by the model's constant. Rows that repeat an id are
    judged one by one. Of rules of the same length the larger text wins.
    """
    weights, base = fit(labelled)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in text_slices(batch, "path"):
                found = _scores(*_slots(part.column("host"), part.column("path")), part.num_rows, weights, base)
                yield batches({**{c: part.column(c) for c in part.schema.names}, "score": pa.array(found)})

    url = F.col("url").cast("string")
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = urls.mapInArrow(run, "row long, page_id long, url string, host string, path string, score double")
    found = matching_rules(stage(scored, "urls"), rules)
    model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return found.select("page_id", "url", "host", "path", "rule", "score", F.coalesce("rule_verdict", model).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by its URL."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES = {"op7_url_filter": (op7_url_filter, None)}
