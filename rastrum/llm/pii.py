"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Pass 1 finds candidates in every whole text, far more than are personal: numbers of many forms, dates, addresses, capitalised words.
Labelers of three sorts vote yes, no or nothing on each: patterns and checksums (regex), lists (gazetteer) and neighbouring words
(context). Spark counts the distinct patterns of votes, whose number doesn't depend on the input, and on these counts the driver
estimates each labeler's reliability, kind by kind, with expectation-maximisation (two classes, three votes). The
final span classifier doesn't see votes: it is a logistic regression over hashed words and shapes of the span and around it, trained on
the EM's probabilities of a bounded sample of candidates. Pass 2 reads the candidates, not the texts, and keeps every base span and
those that the classifier accepts.

Defined cases: null texts count as empty; repeated rows are worked on one by one; only ``doc_id`` and ``text`` are read.
Spans are code points, end exclusive. Candidates that overlap a base span or a candidate of a kind listed before aren't taken up. Without
candidates no model is fitted and every row has empty spans.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_batch, sha, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
#: Base kinds first; the classifier can add spans of any kind.
KINDS = (*BASE_KINDS, "iban", "ssn", "date", "address", "id", "name")
EM_ROUNDS, FIT_ROUNDS, ACCEPT = 40, 120, 0.5
#: The classifier is fitted on about so many candidates of each kind at most, drawn by a hash of doc_id; features are hashed to so many numbers.
MAX_TRAIN_PER_KIND, FEATURES = 5000, 1 << 15

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MONTH = "(?:Jan(?:uary|uar)?|Feb(?:ruary|ruar)?|Mar(?:ch|zo)?|Apr(?:il)?|May|Mai|June?|Juni|July?|Juli|Aug(?:ust)?|Sep(?:tember)?|O[ck]t(?:ober)?|Nov(?:ember)?|De[cz](?:ember)?)"
_WEAK = {
    "email": re.compile(r"(?<!\w)[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,4}"),
    "iban": re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "date": re.compile(rf"(?<![0-9])(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}([./-])[0-9]{{1,2}}\1[0-9]{{4}}|[0-9]{{1,2}}\.?\x20{_MONTH}\x20[0-9]{{4}}|{_MONTH}\x20[0-9]{{1,2}},\x20[0-9]{{4}})(?![0-9])"),
    "address": re.compile(r"(?<!\w)(?:[0-9]{1,5}\x20(?:[A-Z][a-z]{1,20}\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Place|Square)|[A-Z][a-zäöü]{2,20}(?:straße|strasse|weg|platz|gasse)\x20[0-9]{1,4}|[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place)(?:\x20[A-Za-zéèàç]{1,20}){1,4}|(?:Calle|Avenida|Plaza)(?:\x20[A-Za-zñáéíóú]{1,20}){1,3},?\x20[0-9]{1,4})(?!\w)"),
    "phone": re.compile(r"(?<![0-9+])(?:\([0-9]{2,5}\)\x20?)?[0-9](?:[\x20./-]?[0-9]){6,14}(?![0-9])"),
    "id": re.compile(r"(?<![0-9A-Z])(?:[A-Z]{1,4}-?[0-9]{5,10}|[0-9](?:[\x20-]?[0-9]){7,18})(?![0-9])"),
    "name": re.compile(r"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sra?)\.?\x20)?[A-Z][a-zäöüßéèñáíóú]{1,20}(?:\x20[A-Z][a-zäöüßéèñáíóú]{1,20}){1,2}(?!\w)"),
}
#: Lists that labelers look into.
TLDS = frozenset("com org net edu gov mil int info biz io dev app co de fr es it uk nl be ch at pl se no dk fi pt ie us ca au nz jp cn in br mx ru eu".split())
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420".split())
IIN = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "35", "36", "38", "6011", "65")
FIRST_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Paul Sandra Steven Ashley Andrew Emily Kenneth Donna George Michelle Joshua Carol Kevin Amanda Brian Laura Edward Emma Peter Anna Julia Alice Jane Martin Simon Kate Helen Oliver Sophie "
    "Hans Klaus Peter Wolfgang Jürgen Dieter Stefan Andreas Ursula Monika Petra Sabine Renate Heike Katrin Anja Lukas Lena "
    "Jean Pierre Michel André Philippe Jacques Marie Nathalie Isabelle Sylvie Catherine Camille Luc Claire "
    "Carlos José Juan Luis Antonio Manuel Francisco Javier María Carmen Ana Isabel Dolores Pilar Lucía Elena".split()
)
NOT_NAMES = frozenset("The This That General Public License Licence Commons Creative Apache Free Software Foundation United States New North South East West University Street Road Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December Chapter Section Table Figure Version International Open Source Terms Privacy Policy Contact Us All Rights Reserved Read More Log In Sign Up Home Page".split())
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "payment", "credit", "mastercard", "account"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact", "cell", "telefon", "anruf"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "bank", "account", "konto", "cuenta"),
    "date": ("born", "birth", "dob", "geboren", "geburt", "née", "nacido", "nacimiento"),
    "address": ("address", "live", "lives", "resid", "home", "adresse", "wohn", "dirección", "ship"),
    "id": ("passport", "licence", "license", "id", "identity", "ausweis", "dni", "patient", "employee", "member", "customer", "personal"),
    "name": ("contact", "dear", "by", "from", "signed", "author", "name", "named", "called", "mr", "mrs", "ms", "dr", "prof", "herr", "frau", "regards", "sincerely"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "ref", "ticket", "serial", "section", "release", "example", "build", "published", "updated", "page", "total", "since", "under", "token", "key", "hash", "commit", "sku", "item", "model", "chapter")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in text.split("."))


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each @ outwards, so in time linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((s, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))
    return out


_DIGITS = bytes(48 if 48 <= i <= 57 else 32 for i in range(256))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if b"0" not in text.encode("utf-8", "surrogatepass").translate(_DIGITS):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return out


_NUMBERS = ("iban", "ssn", "date", "address", "phone", "id")
_CAPITALS = re.compile(r"[A-Z][a-zäöüßéèñáíóú]+\x20[A-Z]")


def weak_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates that the base patterns may not take, kind by kind."""
    kinds = set()
    if b"0" in text.encode("utf-8", "surrogatepass").translate(_DIGITS):
        kinds.update(_NUMBERS)
    if any(x in text for x in ("[at]", "(at)")):
        kinds.add("email")
    if _CAPITALS.search(text):
        kinds.add("name")
    return [(k, m.start(), m.end()) for k in _WEAK if k in kinds for m in _WEAK[k].finditer(text)]


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, further candidates that overlap neither base spans nor each other)."""
    if not text:
        return [], []
    base = base_spans(text)
    taken, rest, weak = list(base), [], weak_spans(text)
    for kind in _WEAK:
        if own := [x for x in weak if x[0] == kind]:
            own = apart(own, taken)
            taken += own
            rest += own
    return base, rest


def apart(spans: list[tuple[str, int, int]], others: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of the others."""
    starts, ends = [], []
    for s, e in sorted((s, e) for _, s, e in others):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return [x for x in spans if (k := bisect_right(ends, x[1])) == len(ends) or starts[k] >= x[2]]


_WORDS = re.compile(r"\w+")
_TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "sr", "sra")


def _structure(kind: str, span: str, digits: str) -> bool:
    """Whether checksums, lengths and ranges of the kind hold."""
    if kind == "ip":
        return not span.startswith(("0.", "127.", "255."))
    if kind == "phone":
        return 9 <= len(digits) <= 15 or len(digits) == 7
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00"
    if kind == "date":
        year = int(digits[:4] if re.match("[0-9]{4}", span) else digits[-4:])
        return 1900 <= year <= 2025
    if kind == "email":
        return ".." not in span
    if kind == "id":
        return len(set(digits)) > 2
    return True


def votes_of(kind: str, s: int, e: int, text: str, base: bool) -> str:
    """One vote of + - 0 for each labeler."""
    span = text[s:e]
    digits = "".join(c for c in span if c.isascii() and c.isdigit())
    left, right = text[max(0, s - 40) : s].lower(), text[e : e + 12].lower()
    before, after = text[s - 1 : s], text[e : e + 1]
    near = set(_WORDS.findall(left)) | set(_WORDS.findall(span.lower())[:1] if kind == "name" else ())
    v = ["+" if base else "0"]  # regex: the strict pattern
    if kind in ("card", "iban"):
        v.append("+" if (luhn(digits) if kind == "card" else _iban(span)) else "-")  # regex: checksum
    else:
        v.append("0" if _structure(kind, span, digits) else "-")  # regex: structure
    words = span.split()
    if kind == "email":
        v.append("+" if re.split(r"[.\]) ]", span.lower())[-1] in TLDS else "-")
    elif kind == "phone":
        v.append("0" if span[:1] != "+" else "+" if digits.startswith(CALLING_CODES) else "-")
    elif kind == "card":
        v.append("+" if digits.startswith(IIN) else "-")
    elif kind == "name":
        v.append("-" if any(w in NOT_NAMES for w in words) else "+" if any(w in FIRST_NAMES for w in words) or words[0].rstrip(".").lower() in _TITLES else "0")
    elif kind == "ip":
        v.append("+" if all(len(x) == 1 or x[0] != "0" for x in span.split(".")) else "0")
    else:
        v.append("0")  # gazetteer
    v.append("+" if any(any(w.startswith(c) if len(c) > 3 else w == c for w in near) for c in CUES[kind]) else "0")  # context: cue words
    v.append("-" if any(w in near for w in AGAINST) else "0")  # context: words of other numbers
    edge = before in tuple("/=#_\"'<>|") and before
    v.append("-" if before.isalnum() or after.isalnum() or edge else "0")  # context: edges
    v.append("-" if right.startswith(("%", " %", " eur", " usd", " kg", " km", " items")) or left.rstrip().endswith(("$", "€", "£", "no.", "#")) else "0")  # context: amounts
    v.append("-" if not base and "+" not in v else "0")  # context: nothing speaks for it
    return "".join(v)


def shape(text: str) -> str:
    """Letters as a or A, digits as 9, runs cut to two."""
    out = re.sub("[^\\W\\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub("[0-9]", "9", text))
    return re.sub(r"(.)\1+", r"\1\1", out)


def features_of(kind: str, s: int, e: int, text: str) -> list[int]:
    """Hashed features of the span and of the words around it, all with its kind."""
    span = text[s:e]
    left, right = _WORDS.findall(text[max(0, s - 60) : s].lower())[-4:], _WORDS.findall(text[e : e + 40].lower())[:2]
    before, after = text[s - 1 : s], text[e : e + 1]
    got = ["", f"s{shape(span)[:24]}", f"l{min(len(span), 40) // 3}", f"d{sum(c.isdigit() for c in span)}", f"b{shape(before)}", f"a{shape(after)}", f"h{span[:3].lower()}", f"u{len(set(span)) // 3}"]
    got += [f"p{k}{w}" for k, w in enumerate(reversed(left[-2:]))] + [f"n{k}{w}" for k, w in enumerate(right)]
    got += [f"w{w}" for w in {*left, *right}] + [f"i{w}" for w in _WORDS.findall(span.lower())[:4] if w.isalpha()]
    return sorted({zlib.crc32(f"{kind}|{x}".encode("utf-8", "surrogatepass")) % FEATURES for x in got})


def _candidates(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts_of(batch):
            base, rest = candidates(text)
            rows.append([{"kind": k, "s": s, "e": e, "base": strict, "pattern": f"{k}|{votes_of(k, s, e, text, strict)}", "f": features_of(k, s, e, text)} for spans, strict in ((base, True), (rest, False)) for k, s, e in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string()), ("f", pa.list_(pa.int32()))]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return per_batch(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,s:int,e:int,base:boolean,pattern:string,f:array<int>>>")


#: Votes that each labeler is taken to have cast beforehand, by class and vote (no, nothing, yes): yes leans to personal, no away from it.
PRIOR = 4 * np.array([[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]])


def reliabilities(votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern, labelers' P(yes | class) as 2 x labelers) by EM. votes: patterns x labelers of 1, -1, 0; n: counts. Labelers
    are independent within a class, and each of its three votes has a probability there."""
    post = 0.5 + 0.45 * np.tanh(votes.sum(axis=1))
    cast = votes[:, :, None] == np.array([-1, 0, 1])  # patterns x labelers x votes
    for _ in range(EM_ROUNDS):
        counts = np.stack([(w[:, None, None] * cast).sum(axis=0) for w in (n * (1 - post), n * post)]) + PRIOR[:, None, :]
        theta = counts / counts.sum(axis=2, keepdims=True)
        prior = np.clip(((n * post).sum() + 1) / (n.sum() + 2), 0.02, 0.98)
        log = [np.log(p) + (cast * np.log(t)).sum(axis=(1, 2)) for p, t in ((1 - prior, theta[0]), (prior, theta[1]))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
    return post, theta[:, :, 2]


def posteriors(counts: dict[str, int]) -> dict[str, float]:
    """The probability that a candidate is personal, for each pattern of kind and votes. counts: how often each occurs."""
    out = {}
    for kind in sorted({p.split("|")[0] for p in counts}):
        patterns = sorted(p for p in counts if p.split("|")[0] == kind)
        votes = np.array([[{"+": 1, "-": -1, "0": 0}[c] for c in p.split("|")[1]] for p in patterns])
        post, _ = reliabilities(votes, np.array([counts[p] for p in patterns], float))
        out |= dict(zip(patterns, post.tolist(), strict=True))
    return out


def fit(rows: list[list[int]], post: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the hashed features, by ascent on the expected likelihood of the probabilities ``post``."""
    flat = np.fromiter((f for r in rows for f in r), np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    weight = weight / weight.sum()
    for _ in range(FIT_ROUNDS):
        z = np.bincount(of, w[flat], len(rows))
        g = np.bincount(flat, ((post - 1 / (1 + np.exp(-np.clip(z, -60, 60)))) * weight)[of], FEATURES) - 1e-6 * w
        squares += g * g
        w += 0.3 * g / np.sqrt(squares)
    return w


def train(found: DataFrame) -> np.ndarray:
    """The classifier's weights, from the candidates of all documents: all count for the labelers' reliabilities, a sample of each kind for
    the fit, weighed so that a kind counts by the root of its number."""
    spans = found.select("doc_id", F.explode("spans").alias("x"))
    counts = {r["p"]: r["n"] for r in spans.groupBy(F.col("x.pattern").alias("p")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return np.zeros(FEATURES)
    post = posteriors(counts)
    kinds: dict[str, int] = {}
    for p, n in counts.items():
        kinds[p.split("|")[0]] = kinds.get(p.split("|")[0], 0) + n
    share = F.create_map(*[F.lit(x) for k, n in kinds.items() for x in (k, min(1.0, MAX_TRAIN_PER_KIND / n))])
    drawn = spans.where(F.pmod(F.xxhash64("doc_id", "x.s"), F.lit(1 << 30)) < F.element_at(share, F.col("x.kind")) * (1 << 30))
    got = sorted(((r["pattern"], r["f"]) for r in drawn.select("x.pattern", "x.f").collect()), key=lambda r: (r[0], r[1]))
    if not got:
        return np.zeros(FEATURES)
    return fit([f for _, f in got], np.array([post[p] for p, _ in got]), np.array([1 / np.sqrt(kinds[p.split("|")[0]]) for p, _ in got]))


def score(features: list[list[int]], weights: np.ndarray) -> np.ndarray:
    """The probability of each candidate by its features."""
    z = np.array([weights[f].sum() for f in features])
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (with those the classifier adds), n_added, n_rejected."""
    found = cut(_candidates(docs), "pii")
    weights = train(found)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for spans in batch.column("spans").to_pylist():
            order = lambda xs: ",".join(f"{x['kind']}:{x['s']}:{x['e']}" for x in sorted(xs, key=lambda x: (KINDS.index(x["kind"]), x["s"], x["e"])))
            base, weak = [x for x in spans if x["base"]], [x for x in spans if not x["base"]]
            more = [x for x, p in zip(weak, score([x["f"] for x in weak], weights), strict=True) if p >= ACCEPT]
            rows.append([*(sum(x["kind"] == k for x in base) for k in BASE_KINDS), sha(order(base)), order(base + more), len(more), len(weak) - len(more)])
        cols = list(zip(*rows, strict=True))
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_rejected"])

    return per_batch(found, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_rejected long")
