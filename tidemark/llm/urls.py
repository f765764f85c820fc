"""Operator 6, URL filters by host word segmentation.

Rules come first: the longest fitting (host, path) rule decides.  Where none fits, host names are
cut at dots, hyphens, underscores and digits, the pieces are split into words by a unigram
Viterbi search, and a multinomial naive Bayes model over the words of host and path gives the
verdict.

The unigram counts are those of the texts, hosts and paths of all pages, counted by word, and of the
example sites below, which have a tenth of the weight at least.  A run that stands alone between
dots or slashes of a url (`cheappills`) may be several words: from the shortest on, those that the
words known by then spell go to these, the others are words themselves.  Unknown stretches cost
more the longer they are.  The most frequent words, `VOCABULARY` at most, are held; rarer ones are unknown.

Labels begin with the example sites, a list by hand that names no site of the tables.  From them the
model grows: a host counts as blocked if the list's words alone say so clearly, as another if not,
and words that at least `LEAST_HOSTS` hosts have, but the list does not, get the odds of the two
kinds of hosts, each word counted once a host so that no large host decides.  Pages that a rule
decides are no examples: rules go by public ending and language, and their verdicts hold for no
other page of the host.

Three passes; words are combined map-side, and the driver takes the most frequent alone.  Segmented
pieces are remembered by each task (a bounded cache).

Defined results: a null url or one without `://` has an empty host and path, no rule, and is
allowed; empty hosts are no evidence; a host without a dot is a name; repeated rows get the same
verdict each; null html has no words; a null page_id is carried along; no rows, no result; other
columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import most_frequent, prepare, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Labelled examples, as words of host and path.
BLOCKED = """online casino bonus | best slots | poker room
bet now | sports betting odds | free spins | jackpot win | cheap meds | buy viagra | pharmacy discount pills | payday loan
quick loans | credit cash | hot girls | sex cams | porn tube | xxx video | adult dating | live cams | escort girls | click track
ad server | ads click | banner ads | pop ads | tracker pixel | spam mail | link farm | seo links | replica watches | cheap replica
crack keygen | warez download | free torrent | malware payload | phish login | win prize | lottery win | free money | get rich
weight loss pills | miracle cure | essay mill | fake followers | betting tips""".replace("\n", " | ")
ALLOWED = """news | daily news | world news | tech | science journal | university | city library | museum | open source
code docs | developer guide | travel guide | food recipes | cooking | health clinic | hospital | school | research institute
weather | sports news | football club | music | film review | book review | history | garden | shop | store | online shop | book store
photo | art gallery | maps | bank | law | government | city council | community forum | wiki | encyclopedia | language course
radio | local radio | farm museum | track record | docs archive | article archive"""
#: Words of the structure of urls, which say nothing about a site; they count for segmentation only.
NEUTRAL = """en | de | fr | es | it | page | about | www | m | mail | blog | api | static | cdn | img | help | support | home | index | html
htm | php | feed | tag | category | contact | example | com | org | net | ref | id"""


def _words(listed: str) -> list[list[str]]:
    return [x.split() for x in listed.replace("\n", " | ").split("|") if x.split()]


class Segmenter:
    """Unigram Viterbi: the likeliest cut of a run of letters into words."""

    def __init__(self, counts: Counter, longest: int = 24) -> None:
        self.counts, self.total, self.longest = counts, sum(counts.values()), longest

    def cost(self, word: str) -> float:
        """-log of the word's probability; an unknown word's falls tenfold with each letter."""
        n = self.counts.get(word) if len(word) <= self.longest else None
        return -log(n / self.total) if n else log(self.total) + len(word) * log(10)

    def split(self, text: str) -> list[str]:
        """Linear in the text: known words end in `longest` letters, and an unknown one of any length
        goes on letter by letter."""
        n, get, begin = len(text), self.counts.get, log(self.total) if self.total else 0.0
        best, back = [0.0], [0]
        unknown, since = begin, 0  # the best cost of an unknown word that is open, and where it began
        for i in range(1, n + 1):
            unknown += _LETTER
            cost, j = unknown, since
            for k in range(max(0, i - self.longest), i):
                c = get(text[k:i])
                if c:
                    c = best[k] + begin - log(c)
                    if c < cost:
                        cost, j = c, k
            best.append(cost)
            back.append(j)
            if cost + begin < unknown:
                unknown, since = cost + begin, i
        out, i = [], n
        while i:
            out.append(text[back[i] : i])
            i = back[i]
        return out[::-1]


class NaiveBayes:
    """Multinomial, with Laplace smoothing over the known words; log odds of blocking."""

    def __init__(self, blocked: list[list[str]], allowed: list[list[str]], alpha: float = 0.5, share: float = 0.2) -> None:
        b, a = (Counter(w for x in side for w in x) for side in (blocked, allowed))
        known = set(a) | set(b)
        nb, na = sum(b.values()) + alpha * len(known), sum(a.values()) + alpha * len(known)
        self.prior = log(share / (1 - share))  # the share of sites to block, as assumed
        self.odds = {w: log((b[w] + alpha) / nb) - log((a[w] + alpha) / na) for w in known}

    def score(self, words: list[str]) -> float:
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


LISTED = Counter(w for x in _words(BLOCKED) + _words(ALLOWED) + _words(NEUTRAL) for w in x)
SEGMENTER = Segmenter(Counter(LISTED))
#: Pieces that the driver and each task hold; letters of a run that may be split into words.
VOCABULARY, LONGEST_RUN = 100_000, 64
#: Hosts that must have a word that the list lacks, and log odds of a host that is clearly blocked.
LEAST_HOSTS, CLEARLY = 5, 1.0
BAYES = NaiveBayes(_words(BLOCKED), _words(ALLOWED))
_LETTER = log(10)
_PIECE = re.compile(r"[^\W\d_]+")
_UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
_BETWEEN = re.compile(r"[./]")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = _END.search(rest)
    host = rest[: m.start()] if m else rest
    path = _PATH_END.split(rest[len(host) :], maxsplit=1)[0]
    return host.translate(_UPPER), path


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The longest rule that fits."""
    fits = []
    for rule, verdict in rules:
        at = rule.index("/") if "/" in rule else len(rule)
        name, start = rule[:at], rule[at:]
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else None


def _tokens(segmenter: Segmenter, text: str) -> tuple[str, ...]:
    return tuple(w for piece in _PIECE.findall(text) for w in segmenter.split(piece.lower()))


def _cutter(segmenter: Segmenter):
    """Tokens of a host or path; what is long is not remembered."""
    near = lru_cache(maxsize=200_000)(partial(_tokens, segmenter))
    return lambda text: near(text) if len(text) <= 200 else _tokens(segmenter, text)


#: By the example sites alone.
tokens = _cutter(SEGMENTER)


def _named(host: str) -> str:
    """The host without its public ending, if it has one."""
    name = host.rsplit(":", 1)[0].rstrip(".")
    return name.rpartition(".")[0] or name


def judge(url: str | None, rules=RULES, cut=tokens, bayes: NaiveBayes = BAYES) -> tuple[str, str, str | None, str, float]:
    host, path = parts(url)
    odds = bayes.score([*cut(_named(host)), *cut(path)]) if host or path else bayes.prior
    found = rule_for(host, path, rules) if host else None
    return host, path, found[0] if found else None, found[1] if found else "block" if odds > 0 else "allow", odds


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of hosts and paths: how often beside others (words), and alone (runs)."""
    for b in batches:
        words, runs = Counter(), Counter()
        for url in b.column(0).to_pylist():
            host, path = parts(url)
            for between in _BETWEEN.split(f"{_named(host)}/{path}"):
                found = [x.lower() for x in _PIECE.findall(between)]
                (runs if len(found) == 1 else words).update(x for x in found if len(x) <= LONGEST_RUN)
        every = sorted(words.keys() | runs.keys())
        cols = [pa.array(every, pa.string()), *(pa.array([c[x] for x in every], pa.int64()) for c in (words, runs))]
        yield pa.RecordBatch.from_arrays(cols, ["piece", "words", "runs"])


def segmenter(words: dict[str, int], runs: dict[str, int]) -> Segmenter:
    """Unigram counts from pieces: runs that known words spell count for these."""
    share = max(1, (sum(words.values()) + sum(runs.values())) // (9 * LISTED.total()))
    known = Segmenter(Counter({w: n * share for w, n in LISTED.items()}) + Counter(words))
    for run in sorted(runs, key=lambda x: (len(x), x)):
        spelt = [run] if run in known.counts else known.split(run)
        if not all(len(w) > 2 and w in known.counts for w in spelt):
            spelt = [run]
        for w in spelt:
            known.counts[w] += runs[run]
        known.total += runs[run] * len(spelt)
    return known


def text_words(pages: DataFrame) -> DataFrame:
    """(piece, words): how often each run of letters occurs in the pages' texts."""
    text = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*>|&[a-z#0-9]{1,32};", " ")
    found = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("piece")).where("length(piece) between 2 and 24")
    return found.groupBy("piece").agg(F.count(F.lit(1)).alias("words"))


def learn(pages: DataFrame, vocabulary: int = VOCABULARY) -> Segmenter:
    """The segmenter of all pages' texts, hosts and paths."""
    counted = pages.select("url").mapInArrow(_pieces, "piece string, words long, runs long")
    if "html" in pages.columns:
        counted = counted.union(text_words(pages).select("piece", "words", F.lit(0).cast("long")))
    counted = counted.groupBy("piece").agg(F.sum("words").alias("words"), F.sum("runs").alias("runs"))
    top = most_frequent(counted.withColumn("all", F.col("words") + F.col("runs")), "all", vocabulary)
    return segmenter({r.piece: r.words for r in top if r.words}, {r.piece: r.runs for r in top if r.runs})


def _words_of_hosts(rules, known: Segmenter):
    """(host, token, blocked) of the urls that no rule decides; a host is blocked by the words of the
    list that its own name has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(known)
        for b in batches:
            rows = set()
            for url in b.column(0).to_pylist():
                host, path = parts(url)
                if host and rule_for(host, path, rules) is None:
                    name = cut(_named(host))
                    blocked = BAYES.score(list(name)) > CLEARLY
                    rows.update((host, t, blocked) for t in {*name, *cut(path)} if t not in LISTED and len(t) > 1)
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.bool_()), strict=True)], ["host", "token", "blocked"])

    return run


def grow(pages: DataFrame, known: Segmenter, rules=RULES, *, vocabulary: int = VOCABULARY, least_hosts: int = LEAST_HOSTS) -> NaiveBayes:
    """The list's model with the words of the pages' hosts and paths."""
    seen = pages.select("url").mapInArrow(_words_of_hosts(tuple(rules), known), "host string, token string, blocked boolean").distinct()
    n = seen.groupBy("token").agg(F.count(F.when(F.col("blocked"), 1)).alias("b"), F.count(F.when(~F.col("blocked"), 1)).alias("a")).checkpoint()
    total = n.agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count(F.lit(1)).alias("n")).first()
    top = most_frequent(n.withColumn("hosts", F.col("a") + F.col("b")).where(F.col("hosts") >= least_hosts), "hosts", vocabulary)
    bayes = NaiveBayes(_words(BLOCKED), _words(ALLOWED))
    if total["b"] and total["a"]:
        nb, na = (total[x] + 0.5 * total["n"] for x in "ba")
        bayes.odds |= {r.token: log((r.b + 0.5) / nb) - log((r.a + 0.5) / na) for r in top}
    return bayes


def _judge(rules, known: Segmenter, bayes: NaiveBayes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(known)
        for b in batches:
            got = [judge(u, rules, cut, bayes) for u in b.column(1).to_pylist()]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["page_id", "host", "path", "rule", "verdict", "log_odds"])

    return run


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds of the model whatever the rule)."""
    known = learn(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return rows.mapInArrow(_judge(tuple(rules), known, grow(rows, known, rules)), "page_id long, host string, path string, rule string, verdict string, log_odds double")


def query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
