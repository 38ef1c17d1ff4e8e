"""Operator 1. Secret scans: a random forest on candidate strings, trained from labelled findings."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: A candidate: a run of at least so many of these signs with a digit, or with both cases, in it.
SHORTEST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-.=~]{%d,}" % SHORTEST)
#: What is given to a name that credentials have, quoted or not, or stands as password in a URL, is a candidate whatever its signs.
ASSIGNED = re.compile(r"""(?i)(?<![a-z0-9])(?:password|passwd|passphrase|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)["']?\s*(?:=|:=|:|=>)\s*(?:"([^"\n]{4,200})"|'([^'\n]{4,200})'|([^\s"',;<>]{6,200}))|://[^\s:/@]+:([^\s:/@]{4,200})@""")
#: Labelled findings that a forest is trained on, at most; its trees and depth.
FINDINGS, TREES, DEPTH = 20_000, 24, 8
#: Words whose cover speaks against a secret, words before or after a candidate that speak for or against one.
DICTIONARY = ("about after apple backup build cache change client cloud code commit config content data date default demo deploy document dummy entry error example fake file filter first group hello image index input issue item label language large library line list local login main manager master message model module name network node note object option order output package page path pipeline place plain process project public query record release report request response result sample schema script search second section server service session setting simple small sorted source spark stage start state static status string style summary system table target task temp test text theme time title tree update user value version view window word world").split()
FOR = frozenset("password passwd pwd pass secret token key apikey api_key api-key access_key accesskey auth authorization bearer credential credentials private_key client_secret signature".split())
AGAINST = frozenset("commit sha sha1 sha256 md5 digest checksum hash etag revision rev version uuid guid id build ref integrity blob tree mail email url href src file path image see line page isbn".split())
PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|example|changeme|placeholder|dummy|sample|your[_-]|redacted|0{8,}|1234567")
SPLIT = re.compile(r"[\s\"'`<>(),;:|=!&%$#*?{}\[\]]+")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
NAMES = ("length", "entropy", "digit_share", "upper_share", "punctuation_share", "hex", "class_changes", "repeats", "vowel_share", "bigram", "dictionary_share", "uuid", "placeholder", "slashes", "dots", "extension", "mail", "assigned", "quoted", "word_for", "word_against", "words_near", "prefix", "path_for", "path_against", "blanks", "assigned_value")
#: Parts of a path that speak for secrets or against them.
PATH_FOR, PATH_AGAINST = re.compile(r"(?i)(^|[/._-])(env|config|conf|settings|secrets?|credentials?|keys?|pem|deploy|terraform)([/._-]|$)"), re.compile(r"(?i)(^|[/._-])(tests?|examples?|docs?|samples?|fixtures?|mocks?|demo)([/._-]|$)")
#: Pairs of letters that ordinary words hold often.
COMMON_PAIRS = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split())
KNOWN_PREFIX = re.compile(r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|pk_live_|xox[abp]-|AIza|glpat-|eyJ|SG\.)")
FOUND = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType()), T.StructField("features", T.ArrayType(T.DoubleType()))])


def features(text: str, start: int, end: int, path: str | None = None) -> list[float]:
    """The NAMES of the candidate text[start:end], from it, the words around it and the path that the text comes from."""
    s = text[start:end]
    n = len(s)
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in s]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1)
    low = s.lower()
    letters = [c for c in low if c.isalpha()]
    pairs = [low[i : i + 2] for i in range(n - 1) if low[i : i + 2].isalpha()]
    covered = bytearray(n)
    for w in DICTIONARY:
        at = low.find(w)
        while at >= 0:
            covered[at : at + len(w)] = b"\x01" * len(w)
            at = low.find(w, at + 1)
    before, after = text[max(0, start - 48) : start], text[end : end + 32]
    words = [w.lower() for w in SPLIT.split(before) if w][-3:]
    later = [w.lower() for w in SPLIT.split(after) if w][:2]
    inside = [w for w in re.split(r"[=]+", low) if w]
    near = set(words) | set(later) | set(inside[:-1])
    edge = before[-3:].strip()[-1:]
    return [float(x) for x in (
        min(n, 200), entropy, kinds.count(0) / n, kinds.count(1) / n, kinds.count(3) / n, all(c in "0123456789abcdef" for c in low), changes, sum(a == b for a, b in zip(s, s[1:])) / n,
        sum(c in "aeiou" for c in letters) / max(len(letters), 1), sum(p in COMMON_PAIRS for p in pairs) / max(len(pairs), 1), sum(covered) / n, bool(UUID.match(s)), bool(PLACEHOLDER.search(s)), low.count("/"), low.count("."),
        bool(re.search(r"\.[a-z]{2,4}$", low)), "@" in before[-1:] + after[:1], edge in "=:" and bool(edge) or "=" in s[:-2], edge in "\"'`" and bool(edge), bool(near & FOR), bool(near & AGAINST), len(words), bool(KNOWN_PREFIX.match(s)),
        bool(PATH_FOR.search(path or "")), bool(PATH_AGAINST.search(path or "")), s.count(" "), any(m.span(m.lastindex or 0) == (start, end) for m in ASSIGNED.finditer(text, max(0, start - 64), min(len(text), end + 2))),
    )]


def candidates(text: str | None) -> Iterator[tuple[int, int]]:
    """Spans in order, none in another: long runs, and values given to names of credentials, which take the place of runs within them."""
    text = text or ""
    runs = [m.span() for m in CANDIDATE.finditer(text) if (s := m.group()) and (not s.isalpha() and any(map(str.isdigit, s)) or (s[1:].lower() != s[1:] and s.upper() != s))]
    given = [m.span(m.lastindex or 0) for m in ASSIGNED.finditer(text)]
    end, out = 0, []
    for a, b in sorted([*runs, *given], key=lambda x: (x[0], -x[1])):
        if a >= end:
            out.append((a, b))
            end = b
    yield from out


def example_findings(n: int = 4000, seed: int = 7) -> list[tuple]:
    """Labelled findings (text, start, end, label, path) by rule: secrets of common formats in common surroundings, and what looks like one but isn't."""
    rng = random.Random(seed)
    some = lambda signs, a, b=None: "".join(rng.choice(signs) for _ in range(rng.randint(a, b or a)))
    upper, hexes, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "the er ti on an re he in ed nd or es st en at to nt ha ve al is ou la de le que ein sch ung ción".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    signs = "!@#$%^&*?-_+"
    passphrase = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(3, 6)))
    named = lambda: rng.choice(["password", "DB_PASS", "passwd", "admin_pwd", "secret", "app_token", "api_key", "smtp_password"])
    odd = lambda: some(mixed, 4, 8) + rng.choice(signs) + some(mixed + signs, 2, 6)
    positive = (
        lambda: (f"{named()}{rng.choice([': ', '=', ' = '])}", odd(), ""), lambda: (f"{named()} = \"", odd(), "\""), lambda: (f"{named()} = '", passphrase() + some("0123456789", 1, 3), "'"), lambda: (f"{rng.choice(['mysql', 'redis', 'amqp'])}://{word()}:", some(mixed + "!$-", 6, 16), "@db.internal/x"),
        lambda: (f"{named()}=\"", passphrase() + passphrase(), "\""),
        lambda: ("", "AKIA" + some(upper, 16), ""), lambda: ("", "ghp_" + some(mixed, 36), ""), lambda: ("", "sk-" + some(mixed, 32, 48), ""), lambda: ("key ", "AIza" + some(mixed + "-_", 35), ""),
        lambda: (rng.choice(["token = \"", "secret: \"", "api_key = '", "auth = \""]), some(hexes, 32, 40), rng.choice("\"'")), lambda: ("", rng.choice(["password=", "passwd=", "pwd=", "secret=", "token="]) + some(hexes, 14, 24), ""),
        lambda: (rng.choice(["password: ", "client_secret = ", "Authorization: Bearer ", "private_key "]), some(mixed + "+/", 20, 44), ""), lambda: ("", rng.choice(["password=", "api_key=", "token="]) + some(mixed, 12, 30), ""),
    )
    plain = "required missing string optional none null true false invalid expired hidden unknown default undefined".split()
    negative = (
        lambda: (f"{named()}: ", rng.choice(plain), ""), lambda: (f"{named()} = \"", rng.choice([*plain, "your password here", "enter a value", "******", "{{ value }}", "${SECRET}", "<redacted>"]), "\""), lambda: (f"{named()}=", rng.choice(["os.environ", "getenv(KEY)", "config.value", "self.token", "$PASSWORD", "%(value)s"]), ""),
        lambda: (f"{named()}: ", word() + word(), " " + prose(3)),
        lambda: (rng.choice(["commit ", "sha256 ", "md5 ", "checksum: ", "etag \"", "revision ", "digest="]), some(hexes, rng.choice([32, 40, 64])), ""), lambda: (rng.choice(["id ", "uuid: ", ""]), "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)), ""),
        lambda: (rng.choice(["password=", "token = \"", "api_key="]), rng.choice(["changeme-please-1", "your_token_here_1", "xxxxxxxxxxxxxxxx1", "example-password-1", "********00000000", "1234567890123456"]), ""),
        lambda: (rng.choice(["see ", "file ", "href ", ""]), "/".join(rng.sample(DICTIONARY, 3)) + f"/{rng.choice(DICTIONARY)}{rng.randint(1, 99)}.{rng.choice(['html', 'py', 'png', 'txt'])}", ""), lambda: ("", f"{word()}.{rng.randint(10, 99)}", "@mail.example.com"),
        lambda: ("mail ", f"mail{rng.randint(0, 9)}.example.com", ""), lambda: ("", f"{rng.randint(1, 254)}.{rng.randint(1, 254)}.{rng.randint(1, 254)}.{rng.randint(100, 254)}", ""), lambda: ("", "-".join(rng.sample(DICTIONARY, 3)) + f"-{rng.randint(1, 9)}", ""),
        lambda: ("", f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}.30.00", ""), lambda: ("", some("0123456789", 12, 19), ""), lambda: ("", "".join(w.capitalize() for w in rng.sample(DICTIONARY, 3)) + str(rng.randint(1, 9)), ""),
    )
    out = []
    for i in range(n):
        label = i % 2
        before, value, after = rng.choice(positive if label else negative)()
        head = prose(rng.randint(0, 8)) + " " + before
        likely, unlikely = f"{word()}/config/{word()}.env", f"tests/{word()}/example_{word()}.md"
        path = rng.choice([None, f"src{rng.randint(0, 30)}", likely if label else unlikely, rng.choice([likely, unlikely])])
        out.append((head + value + after + " " + prose(rng.randint(0, 8)), len(head), len(head) + len(value), label, path))
    return out


def train(spark: SparkSession, findings: list[tuple] | None = None, *, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings (text, start, end, label 0 or 1, and a path or nothing); of more than FINDINGS those with the lowest
    digests. The example findings if none are given."""
    rows = sorted(example_findings() if findings is None else findings, key=lambda r: hashlib.md5(repr(r[:3]).encode()).digest())[:FINDINGS]
    if len({r[3] for r in rows}) < 2:
        raise ValueError("findings of both labels are needed")
    data = spark.createDataFrame([(features(t, a, b, *path), float(y)) for t, a, b, y, *path in rows], "x array<double>, label double").coalesce(1)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="v", minInstancesPerNode=4, subsamplingRate=0.8)
    return forest.fit(data.select("label", array_to_vector("x").alias("v")))


def _scan(kept: list[str], text_col: str, path_col: str | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            paths = batch.column(path_col) if path_col else None
            for i, text in enumerate(batch.column(text_col)):
                text = text.as_py()
                for a, b in candidates(text):
                    rows.append(i)
                    found.append((a, b, text[a:b], features(text, a, b, paths[i].as_py() if paths is not None else None)))
            columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in kept]
            new = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*columns, *new], [*kept, *FOUND.names])

    return run


def scan(docs: DataFrame, model: RandomForestClassificationModel, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5, all_candidates: bool = False) -> DataFrame:
    """One row per finding: id, start and end (characters of the whole text), value, score. Candidates that the forest takes for false
    positives go, unless all_candidates is set. A narrow pass: Python marks candidates with their features, the forest scores them in
    the JVM; no shuffle, so neither frequent sources nor copies heat a task.

    Null text has no findings, a null path speaks neither way; texts of any length are read whole; candidates don't overlap, and of two that
    begin together the longer counts; repeated rows and ids give their findings each; an empty table gives none; further columns are
    ignored."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(path_col).cast("string").alias("path")] if path_col else []))
    found = docs.mapInArrow(_scan(["id"], "text", "path" if path_col else None), T.StructType([docs.schema["id"], *FOUND.fields])).withColumnRenamed("id", id_col)
    scored = model.transform(found.withColumn("v", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])
    scored = scored if all_candidates else scored.where(F.col("score") >= threshold)
    return scored.select(id_col, "start", "end", "value", "score")
