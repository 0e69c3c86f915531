"""Personal data: labelers vote on candidate spans, EM finds their reliabilities, a span classifier decides.

Four kinds have fixed base rules, whose spans always stay. Weaker candidates (numbers that look like phones or ids, written-out
addresses, account numbers, names that a title, the words before or a gazetteer propose) get votes of regex, checksum, context
and gazetteer labelers. Vote patterns are
counted over all documents; expectation-maximisation over these counts (at most KINDS x 3 ** labelers rows) gives each
pattern a probability. A logistic regression on votes and shape, fitted on a bounded sample of candidates with these
probabilities as labels, scores every candidate.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.common import Scratch, smallest_hashes, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "iban", "name")
#: At most so many candidates are fitted on: those with the smallest hashes.
SAMPLE = 20_000
ROUNDS, ACCEPT = 50, 0.5
#: Characters before a span in which cue words count.
BEFORE = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")
# a match never starts within a run of digits: if the run's first digit fails, so do the others
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,17}(?![\w-])")
WRITTEN = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]+)+")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: A name that the words before it announce, or that begins with a known given name.
TOLD = re.compile(r"(?<!\w)(?:(?:[Nn]ame|[Nn]om|[Nn]ombre) (?:is|ist|est|es)|[Ss]igned(?: by)?|[Dd]ear|[Cc]ontact(?: person)?:?) ([A-ZÀ-Ý][\w'-]+(?: [A-ZÀ-Ý][\w'-]+){0,2})")
PAIR = re.compile(r"(?<!\w)([A-ZÀ-Ý][\w'-]+) [A-ZÀ-Ý][\w'-]+")
TITLED = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? ([A-ZÀ-Ý][\w'-]+(?: [A-ZÀ-Ý][\w'-]+)?)")

# Fixed word lists.
TELLING = ("ame is", "ame ist", "om est", "ombre es", "igned", "ear ", "ontact")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor")
NAMES = frozenset(
    """adam alan albert alejandro alice amanda amy ana andrea andrew angela anita ann anna anne anthony antonio barbara ben benjamin bernard brian bruno camille carl carla carlos carmen carol caroline
    catherine charles charlotte chloe christian christine claire claudia clara daniel david deborah diana diego dieter donald donna dorothy edward elena elizabeth emil emily emma enrique eric erik eva felix
    fernando francis frank franz fred gabriel george gerard giulia greta guillaume hannah hans heinrich helen helena henri henry hugo ida ines ingrid irene isabel ivan jack jacob jacques james jan jane javier
    jean jeanne jennifer jessica joan john jonas jorge jose joseph josef juan julia julie julien jurgen karen karin karl katharina kevin klaus lara laura lea leon linda lisa louis louise lucas lucia luis lukas
    manuel marc margaret maria marie mario mark markus marta martin mary matthew max michael michel miguel monika nancy nicolas nicole nina olivia oscar otto pablo patricia patrick paul paula pedro peter
    philip pierre pilar rafael richard robert rosa ruth samuel sandra sara sarah sebastian sergio simon sofia sophie stefan stephen steven susan sven sylvia teresa theresa thomas ursula victor walter william""".split()
)
CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "anruf", "numéro", "móvil"),
    "id": ("ssn", "social security", "passport", "national id", "ausweis", "dni", "tax id"),
    "iban": ("iban", "account", "konto", "compte", "cuenta"),
    "name": ("name", "dear", "signed", "contact", "born"),
}
AGAINST = ("version", "isbn", "issn", "page", "license", "http", "$", "€", "%", "#", "commit", "sha")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @, so that long runs of letters cost no more than their length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(last, at + 1))
    return out


def united(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the spans' union, ascending."""
    starts, ends = [], []
    for a, z in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], z)
        else:
            starts.append(a)
            ends.append(z)
    return starts, ends


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    found["email"] = emails(text)
    if DIGIT.search(text):
        found["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = digits_of(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            n = len(digits_of(m.group()))
            kind = "id" if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m.group()) else "phone" if 7 <= n <= 12 else "card"
            out.append((kind, *m.span()))
        out += [("iban", *m.span()) for m in ACCOUNT.finditer(text)]
    if any(x in text for x in ("(dot)", "[dot]", " dot ")):
        out += [("email", *m.span()) for m in WRITTEN.finditer(text)]
    if any(t in text for t in TITLES):
        out += [("name", *m.span(1)) for m in TITLED.finditer(text)]
    if any(t in text for t in TELLING):
        out += [("name", *m.span(1)) for m in TOLD.finditer(text)]
    out += [("name", *m.span()) for m in PAIR.finditer(text) if m.group(1).lower() in NAMES]
    return sorted(set(out), key=lambda x: (x[1], x[2], x[0]))


def entropy(x: str) -> float:
    n = len(x)
    return -sum(k / n * math.log2(k / n) for k in Counter(x).values())


def by_shape(kind: str, x: str) -> int:
    digits = digits_of(x)
    if kind == "phone":
        return 1 if re.fullmatch(r"\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,5}", x) else -1 if x.isdigit() else 0
    if kind == "id":
        return 1 if digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000" else -1
    if kind == "card":
        return 1 if re.fullmatch(r"[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}|(?:[0-9]{4}[\x20-]){3}[0-9]{4}", x) else 0
    return 1 if kind in ("iban", "email") else 0


def by_checksum(kind: str, x: str) -> int:
    if kind == "card":
        return 1 if 13 <= len(digits_of(x)) <= 15 and luhn(digits_of(x)) else -1
    if kind == "iban":
        code = x.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else -1
    return 0


def by_context(kind: str, before: str) -> int:
    return 1 if any(c in before for c in CUES[kind]) else 0


def by_contrary(before: str, after: str) -> int:
    return -1 if any(c in before[-12:] or c in after for c in AGAINST) else 0


def by_gazetteer(kind: str, x: str) -> int:
    return 1 if kind == "name" and x.split()[0].lower() in NAMES else 0


def votes(kind: str, x: str, before: str, after: str) -> list[int]:
    return [by_shape(kind, x), by_checksum(kind, x), by_context(kind, before), by_contrary(before, after), by_gazetteer(kind, x)]


def features(kind: str, x: str, vote: list[int]) -> list[float]:
    n = len(x)
    shape = [min(n, 60) / 20, sum(c.isdigit() for c in x) / n, sum(c.isupper() for c in x) / n, entropy(x) / 4]
    return [1.0, *(float(k == kind) for k in KINDS), *(float(v == s) for v in vote for s in (1, -1)), *shape]


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int]) -> dict[tuple[str, tuple[int, ...]], float]:
    """P(personal data) of each (kind, votes), by EM: votes are independent given the truth; each labeler has its own
    rates per kind. Begins from the share of approving votes; pseudo-counts keep labelers better than chance at the start."""
    out = {}
    for kind in sorted({k for k, _ in counts}):
        patterns = sorted(v for k, v in counts if k == kind)
        n = np.array([counts[kind, v] for v in patterns], float)
        v = np.array(patterns)
        p = (1 + (v == 1).sum(1)) / (2 + (v != 0).sum(1))
        prior = np.array([[[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]]]) * 2
        for _ in range(ROUNDS):
            share = (n * p).sum() / n.sum()
            logs = np.tile(np.log([max(share, 1e-6), max(1 - share, 1e-6)]), (len(v), 1))
            for j in range(v.shape[1]):
                rate = np.array([[(n * q * (v[:, j] == s)).sum() for s in (1, 0, -1)] for q in (p, 1 - p)]) + prior[0]
                rate /= rate.sum(1, keepdims=True)
                logs += np.log(rate[:, 1 - v[:, j]]).T
            p = 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -500, 500)))
        out |= {(kind, x): float(q) for x, q in zip(patterns, p, strict=True)}
    return out


def fit_spans(x: np.ndarray, y: np.ndarray, l2: float = 0.01) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / len(y) + l2 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w)), grad)
    return w


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    Spans are kind:start:end in code points, end exclusive, by kind, then start. A null or empty text has none. Added spans
    never overlap base spans or each other (the earlier, then the longer wins). Repeated rows get equal results; a very long
    text is looked through whole, in time linear in its length and its spans. Other
    columns are ignored; an empty table gives no rows, and without candidates nothing is added.
    """
    spark = docs.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = [(k, *x) for k, xs in base_spans(text).items() for x in xs]
                (starts, ends), weak = united([(a, e) for _, a, e in base]), []
                for kind, a, e in candidates(text):
                    # the last base run that begins before the candidate's end is the only one that can reach into it
                    k = bisect_left(starts, e) - 1
                    if k < 0 or ends[k] <= a:
                        x, before = text[a:e], text[max(0, a - BEFORE) : a].lower()
                        vote = votes(kind, x, before, text[e : e + 2].lower())
                        weak.append({"kind": kind, "start": a, "end": e, "votes": vote, "x": features(kind, x, vote)})
                out.append((doc_id, [dict(zip(("kind", "start", "end"), x, strict=True)) for x in base], weak))
            yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, x, strict=True)) for x in out], FOUND)

    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct(span))), ("weak", pa.list_(pa.struct([*span, ("votes", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))])))])
    with Scratch(spark) as s:
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        found = s.save(text.mapInArrow(scan, "doc_id long, base array<struct<kind:string,start:long,end:long>>, weak array<struct<kind:string,start:long,end:long,votes:array<int>,x:array<double>>>"), "found")
        weak = found.select("doc_id", F.explode("weak").alias("w")).select("doc_id", "w.*")
        patterns = {(x["kind"], tuple(x["votes"])): x["count"] for x in weak.groupBy("kind", "votes").count().collect()}
        chance = reliabilities(patterns)
        # candidates that tie in all of this teach the same
        hashed = weak.select("kind", "votes", "x", F.struct(F.xxhash64("doc_id", "start", "kind").alias("h"), F.xxhash64("votes", "x").alias("t")).alias("o")).select("*", "o.h")
        few = smallest_hashes(hashed, sum(patterns.values()), sample).drop("o").toArrow().to_pylist()
        few.sort(key=lambda r: (r["h"], r["x"]))
        w = fit_spans(np.array([r["x"] for r in few]), np.array([chance[r["kind"], tuple(r["votes"])] for r in few])) if few else np.zeros(0)

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for doc_id, base, more in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    spans = [(x["kind"], x["start"], x["end"]) for x in base]
                    digest = hashlib.sha256(joined(spans).encode()).hexdigest()
                    n, end = Counter(k for k, *_ in spans), -1
                    good = [(x["start"], -x["end"], x["kind"]) for x in more if np.dot(x["x"], w) >= math.log(ACCEPT / (1 - ACCEPT))]
                    added = []
                    for a, e, kind in sorted(good):
                        if a >= end:
                            added.append((kind, a, -e))
                            end = -e
                    out.append((doc_id, *(n[k] for k in BASE_KINDS), digest, joined(spans + added), len(added)))
                yield pa.RecordBatch.from_pylist([dict(zip(OUT.names, x, strict=True)) for x in out], OUT)

        OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
        return s.keep(found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
