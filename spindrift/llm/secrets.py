"""Secret scans: patterns propose candidates, a random forest on their features removes the false ones.

Candidates are quoted or bare values after words such as token, key or password, and strings of known shapes (cloud and
service keys, tokens in three parts, private keys, card numbers with a valid check digit). A value of any length goes on as long as its
characters do. A private key goes from its first line through its END line, or to the end of the text where none follows, and
isn't judged (score 1): the forest, which knows one kind of first line, takes others for false. A candidate's features
are its length, its entropy, the share of each kind of character, how often the kind changes from one character to the
next, the mean log-probability of its letter pairs (a table of common pairs), the share of it that words of a public tokenizer's vocabulary cover,
and the words and path separators around it. The forest is trained from labelled findings: LABELLED of each class, made
from the shapes that secrets and their look-alikes (digests of files, identifiers, placeholders, version strings, paths,
prose) take, by a fixed seed. training() takes a table of findings of one's own instead, of at most MOST_LABELLED rows.

Defined results: null texts are empty ones; each row is scanned for itself, so that repeated rows give equal results; a
null id stays null; other columns are kept out. Texts of any length are scanned whole. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LABELLED, MOST_LABELLED = 1500, 100_000
TREES, DEPTH, LEAF = 40, 9, 4
KEEP = 0.5
NAMES = r"(?:secret|token|passw(?:or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|credential|client[_-]?secret|key)"
_PART = r"[-0-9A-Z_a-z]{8,}"
_VALUE = r"[A-Za-z0-9+/=_\-.~!@#$%^&*]"
#: Kind, what a text that matches must contain (nothing: the pattern is tried on all), pattern.
PATTERNS = [
    ("private_key", ("PRIVATE KEY-----",), re.compile(r"(?s)-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:.*?-----END (?:[A-Z]+ )*PRIVATE KEY-----|.*)")),
    ("cloud_key", ("AKIA", "ASIA"), re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")),
    ("service_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "sk_live_", "AIza"), re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35})")),
    ("web_token", ("eyJ",), re.compile(rf"\beyJ{_PART}\.{_PART}\.{_PART}")),
    ("card", (), re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\.?\d)")),
    # the sign: names are looked for in front of it, so that prose costs one pass for two characters; VALUE behind it
    ("assigned", ("=", ":"), re.compile(rf"(?:=>|:=|=|:)\s{{0,3}}[\"']?(?={_VALUE}{{8}})")),
]
VALUE = re.compile(rf"{_VALUE}+")
KINDS = [k for k, _, _ in PATTERNS]
NAMED = re.compile(rf"(?i)(?<![a-z]){NAMES}[\"']?\s{{0,3}}\Z|[_\-]{NAMES}[\"']?\s{{0,3}}\Z")
DIGESTS = re.compile(r"(?i)\b(?:sha1|sha256|sha512|md5|commit|checksum|digest|hash|etag|rev|uuid|integrity|fingerprint)\b")
WORDS = frozenset("the and for with from this that your here change password secret token example test sample dummy default none null true false user name admin value config path home data file server public local host prod dev key api access client auth login put insert enter some any please replace random string placeholder xxx todo env process settings self get set return import class def function var let const http https www com org net readme version build release main index static assets images".split())
_COMMON = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke fr oo av ag if ap gr od bo sp rd do uc bu ei ov by rm ep tt oc fa ef cu rn sc gi da yo cr cl du ga qu ue ff ba ey ls va um pp ua up lu go ht ru ug ds lt pi rc rr eg au ck ew mu br bi pt ak pu ui rg ib tl ny ki rk ys ob mm fu ph og ms ye ud mb ip ub oi rl gu dr hr cc tw ft wn nu af hu nn eo vo rv nf xp gn sm fl iz ok nl my gl aw ju oa eq sy sl ps jo lf nv je nk kn gs dy hy ze ks xt bs ik dd pt rp sk xi oe oy ws lv dl rf eu dg wr xa yi nm eb rb tm xc eh tc gy ja hn yp za gg ym sw bj lm cs ii ix xe oh lk dv lp ax ox uf dm iu sf bt ka yt ek pm ya gt wl rh yl hs ah yc yb hl ov nh".split()
_PAIRS = {p: math.log2(2.0 / (i + 2)) for i, p in enumerate(dict.fromkeys(_COMMON))}
FEATURES = ["length", "entropy", "digits", "upper", "lower", "other", "transitions", "pairs", "covered", "distinct", "hex", "digest_near", "name_near", "slash_near", "quoted", "placeholder", "kind"]


@functools.cache
def dictionary(path: str | None = None) -> frozenset[str]:
    """Words of three letters or more that a public tokenizer's vocabulary has whole, with the short list of those that stand
    around keys. path: of a vocabulary in the tokenizers' JSON format."""
    from .packing import vocabulary

    with open(path or vocabulary()) as f:
        tokens = json.load(f)["model"]["vocab"]
    return WORDS | {t[1:].lower() for t in tokens if t[:1] == "\u0120" and len(t) > 3 and t[1:].isascii() and t[1:].isalpha()}


def _covered(lower: str, words: frozenset[str]) -> int:
    """Letters that dictionary words cover: in each run of letters from the left the longest word, else a letter is passed."""
    total = 0
    for run in re.findall(r"[a-z]{3,}", lower):
        at = 0
        while at < len(run) - 2:
            for end in range(min(len(run), at + 14), at + 2, -1):
                if run[at:end] in words:
                    total += end - at
                    at = end - 1
                    break
            at += 1
    return total


def features(kind: str, value: str, before: str, after: str, words: frozenset[str] = WORDS) -> list[float]:
    n = max(len(value), 1)
    count: dict[str, int] = {}
    for c in value:
        count[c] = count.get(c, 0) + 1
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in value]
    lower = value.lower()
    pairs = [_PAIRS.get(lower[i : i + 2], -9.0) for i in range(len(lower) - 1) if lower[i].isalpha() and lower[i + 1].isalpha()]
    covered = _covered(lower, words)
    return [
        n,
        -sum(k / n * math.log2(k / n) for k in count.values()),
        *(kinds.count(k) / n for k in range(4)),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(pairs) / len(pairs) if pairs else -5.0,
        covered / n,
        len(count) / n,
        float(all(c in "0123456789abcdef" for c in value)),
        float(bool(DIGESTS.search(before))),
        float(bool(re.search(rf"(?i){NAMES}[^a-z]*$", before))),
        float(before[-1:] in "/\\" or after[:1] in "/\\" or value.count("/") > 2),
        float(before[-1:] in "\"'"),
        float(bool(re.search(r"(?i)x{4,}|\*{3,}|\.{3,}|example|your|changeme|placeholder|dummy|<|\$\{|1234567|(.)\1{5,}", value))),
        float(KINDS.index(kind)),
    ]


def check_digit(value: str) -> bool:
    d = [int(c) for c in value if c.isdigit()][::-1]
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Kind, begin, end (code points) of each; those within an earlier pattern's find are left out."""
    out: list[tuple[str, int, int]] = []
    for kind, signs, pattern in PATTERNS:
        if signs and not any(x in text for x in signs):
            continue
        end = 0  # of the last assigned value: signs within it aren't looked at, so that each character is read once
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "assigned":
                if a < end or not NAMED.search(text[max(0, a - 48) : a]):
                    continue
                a, b = VALUE.match(text, b).span()
                end = b
            while kind == "assigned" and b > a and text[b - 1] in ".!@#$%^&*":
                b -= 1
            if b - a < 8 or kind == "card" and not check_digit(text[a:b]):
                continue
            out.append((kind, a, b))
    out.sort(key=lambda x: (x[1], -x[2]))
    kept: list[tuple[str, int, int]] = []
    for x in out:
        if not kept or x[1] >= kept[-1][2]:
            kept.append(x)
        elif x[0] == "private_key":  # a value that runs into a key is part of it
            kept[-1] = (x[0], kept[-1][1], x[2])
    return kept


def findings(seed: int = 11, each: int = LABELLED) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings: kind, value, words before and after, label (1: secret)."""
    r = random.Random(seed)
    pick = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    letters, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    prose = lambda: " ".join(r.choices(sorted(WORDS), k=4))
    names = ["token", "secret", "password", "api_key", "apikey", "access_key", "client_secret", "auth", "key", "pwd"]
    out = []
    for _ in range(each):
        q, name, w = r.choice(["\"", "'", ""]), r.choice(names), prose()
        value = r.choice([lambda: pick(hexes, r.choice([32, 40, 48, 64])), lambda: pick(letters, r.randint(16, 48)), lambda: pick(letters + "+/", r.choice([40, 44, 64])) + r.choice(["", "="]), lambda: pick(letters + "!@#$%^&*", r.randint(10, 20)), lambda: pick(letters + "_-", r.randint(20, 44))])()
        out.append(("assigned", value, f"{w} {name} {r.choice(['=', ':'])} {q}", f"{q} {prose()}", 1))
        shaped = r.choice([("cloud_key", "AKIA" + pick(string.ascii_uppercase + string.digits, 16)), ("service_token", "ghp_" + pick(letters, 36)), ("service_token", "sk-" + pick(letters, 40)), ("web_token", f"eyJ{pick(letters, 20)}.eyJ{pick(letters, 40)}.{pick(letters + '_-', 43)}"), ("card", _card(r)), ("private_key", "-----BEGIN RSA PRIVATE KEY-----")])
        out.append((*shaped, prose() + r.choice([" ", "\n", ": ", "= \""]), r.choice([" ", "\n", "\""]) + prose(), 1))
        words = r.choices(sorted(WORDS), k=5)
        value = r.choice([lambda: "your_" + name + "_here", lambda: "x" * r.randint(8, 32), lambda: "_".join(words[:3]), lambda: ".".join(words[:4]), lambda: "os.environ." + name.upper(), lambda: "changeme123", lambda: "example-" + name, lambda: "${" + name.upper() + "}", lambda: "/".join(words), lambda: words[0] + words[1] + words[2], lambda: "0" * r.randint(8, 20), lambda: "12345678", lambda: "********"])()
        out.append(("assigned", value, f"{prose()} {name} {r.choice(['=', ':'])} {q}", f"{q} {prose()}", 0))
        near = r.choice(["sha256", "commit", "md5", "checksum", "etag", "uuid", "digest", "integrity"])
        value = r.choice([lambda: pick(hexes, r.choice([32, 40, 64])), lambda: "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12))])()
        out.append(("assigned", value, f"{prose()} {near} key: {q}", f"{q} {prose()}", 0))
        shaped = r.choice([("cloud_key", "AKIA" + "EXAMPLE" * 2 + "XX"), ("service_token", "ghp_" + "x" * 36), ("service_token", "sk-" + "your" * 8), ("web_token", "eyJexample.eyJexample.signature" + "x" * 8), ("card", r.choice(["4111111111111111", "0000000000000000", "4242424242424242"])), ("card", _card(r))])
        out.append((*shaped, prose() + (" digest uuid: " if shaped[0] == "card" else " "), " " + prose(), 0))
    return out


def _card(r: random.Random) -> str:
    body = r.choice(["4", "51", "52", "37", "6011"])
    body += "".join(r.choices(string.digits, k=15 - len(body)))
    return next(body + c for c in string.digits if check_digit(body + c))


class Forest:
    """A random forest of binary trees on quantile cuts; leaves hold the share of class 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 5, words: frozenset[str] = WORDS) -> None:
        self.words = words
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x, y, rng.integers(0, len(y), len(y)), rng) for _ in range(trees)]

    @staticmethod
    def _grow(x, y, rows, rng):
        nodes = []  # feature (-1: leaf), cut, left, right, share
        todo = [(rows, 0, None)]
        while todo:
            own, depth, hook = todo.pop()
            at = len(nodes)
            if hook is not None:
                nodes[hook[0]][hook[1]] = at
            share = float(y[own].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if depth == DEPTH or len(own) < 2 * LEAF or share in (0.0, 1.0):
                continue
            best = (1e-9, None)
            for f in rng.choice(x.shape[1], max(2, int(math.sqrt(x.shape[1]))), replace=False):
                v, total = x[own, f], len(own)
                for cut in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 15))):
                    left = v <= cut
                    n = int(left.sum())
                    if LEAF <= n <= total - LEAF:
                        a, b = y[own][left].mean(), y[own][~left].mean()
                        gain = share * (1 - share) - (n * a * (1 - a) + (total - n) * b * (1 - b)) / total
                        if gain > best[0]:
                            best = (gain, (f, cut, left))
            if best[1] is not None:
                f, cut, left = best[1]
                nodes[at][:2] = [int(f), float(cut)]
                todo += [(own[left], depth + 1, (at, 2)), (own[~left], depth + 1, (at, 3))]
        return [np.array(c) for c in zip(*nodes)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += share[at]
        return total / max(len(self.trees), 1)


def train(found: list[tuple[str, str, str, str, int]] | None = None, vocabulary: str | None = None) -> Forest:
    found, words = findings() if found is None else found, dictionary(vocabulary)
    return Forest(np.array([features(*f[:4], words) for f in found]), np.array([f[4] for f in found]), words=words)


def training(labelled: DataFrame) -> Forest:
    """A forest from a table of findings: kind, value, before, after, label. At most MOST_LABELLED rows are taken, by hash."""
    rows = labelled.orderBy(F.xxhash64("kind", "value", "before", "after")).limit(MOST_LABELLED).collect()
    return train([(r.kind, r.value, r.before or "", r.after or "", int(r.label)) for r in rows])


FOUND = "doc_id long, n_candidates long, n_secrets long, secrets array<struct<kind:string,begin:long,end:long,score:double>>"


def _scan(forest, keep: float, redact: bool):
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for batch in shared.slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = [candidates(t) for t in texts]
            flat = [(i, k, a, b) for i, c in enumerate(found) for k, a, b in c]
            judged = np.array([k != "private_key" for _, k, _, _ in flat], bool)
            scores = np.ones(len(flat))
            if judged.any():
                scores[judged] = trees.predict(np.array([features(k, texts[i][a:b], texts[i][max(0, a - 40) : a], texts[i][b : b + 20], trees.words) for (i, k, a, b), j in zip(flat, judged) if j]))
            kept: list[list] = [[] for _ in texts]
            for (i, k, a, b), s in zip(flat, scores):
                if s >= keep:
                    kept[i].append({"kind": k, "begin": a, "end": b, "score": round(float(s), 6)})
            columns = {"doc_id": batch.column("doc_id"), "n_candidates": pa.array([len(c) for c in found], pa.int64()), "n_secrets": pa.array([len(k) for k in kept], pa.int64()), "secrets": pa.array(kept, kinds)}
            if redact:
                columns["text"] = pa.array([redacted(t, k) for t, k in zip(texts, kept)], pa.string())
                columns |= {c: batch.column(c) for c in batch.schema.names if c not in columns}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def redacted(text: str, found: list[dict]) -> str:
    edges = [0, *(x for s in found for x in (s["begin"], s["end"])), len(text)]
    parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return "".join(p + (f"[{found[i]['kind'].upper()}]" if i < len(found) else "") for i, p in enumerate(parts))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", forest: Forest | None = None, keep: float = KEEP) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (kind, begin, end in code points, score) of each document."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_scan(shared.Sent(spark, forest or train()), keep, False), FOUND)


def redact(docs: DataFrame, carried: list[str], forest: Forest | None = None, keep: float = KEEP) -> DataFrame:
    """The documents (doc_id, text and the carried columns) with each secret replaced by its kind in brackets."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *carried)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("doc_id", "text"))
    return rows.mapInArrow(_scan(shared.Sent(spark, forest or train()), keep, True), f"{FOUND}, text string{more}").select(*rows.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
