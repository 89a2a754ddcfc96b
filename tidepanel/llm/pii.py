"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features for what they miss.

The field is trained on the driver from the small labelled table below; tasks decode the neighbourhoods of digits and address
signs of many texts at once, by Viterbi in numpy batches. Its spans never replace those of the patterns.
"""

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidepanel.llm.common import table, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# ---- patterns -------------------------------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does: if it fails there, it fails inside the run as well
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")


def luhn(digits):
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text):
    """Leftmost matches of the address pattern. A match starts where the local part's characters start, so each sign is looked at
    once, and a long word without a sign costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text):
    """(start, end, kind) of the patterns, by start, then kind as listed."""
    out = [(a, b, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


# ---- the field ------------------------------------------------------------------------------------------------------------------

#: The labelled table: spans stand in double braces behind their kind.
LABELLED = """
call {{phone:(415) 555-0134}} after six
phone: {{phone:415-555-0134}} or write to us
tel {{phone:415.555.0134}} fax none
my number is {{phone:(212) 555 0199}} , thanks
reach me on {{phone:020 7946 0958}} today
call {{phone:555-867-5309}}
cell {{phone:1-415-555-0134}} home
telefon {{phone:030 901820 33}} und mehr
tél {{phone:01 42 68 53 00}} pour vous
teléfono {{phone:91 555 01 23}} de la casa
mobile {{phone:(0) 170 555 4321}} ok
text {{phone:(650) 555-0188}} now.
and then {{phone:(303) 555-0144}} with the
of the {{phone:(808) 555-0101}} in an
write to {{email:jane dot doe at example dot com}} soon
mail {{email:bob at example dot org}} please
contact {{email:sales [at] example [dot] com}} for prices
email: {{email:max (at) beispiel (dot) de}} danke
address {{email:info(at)example(dot)org}} here
ask {{email:jo.lee [at] mail.example.net}} about it
reach {{email:j.doe (at) example.com}} now
send it to {{email:ann @ example.com}} today
write {{email:team @ mail.example.org}} again
card {{card:4111-1111-1111 1111}} expires
ip {{ip:10 . 0 . 0 . 1}} is internal
host {{ip:192.168.0[.]12}} answered
server {{ip:172[.]16[.]254[.]1}} down
the year 1999 and 2004 were fine
pages 12 to 340 of the book
version 3.11.2 was released in 2023
version 10.4.2.1.7 of the tool
on 2024-01-15 at 10:30 we met
on 15.01.2024 um 10:30 uhr
room 101 at the end of floor 3
it costs 1,299.00 dollars or 49.99 a month
order 4845168114407329 was sent
number 9807915762804490 in the text
and 4417744280351547 here it is
id 00123456789 in the table
token = " 04dbebab91ab85687d33eeaaf9ac699e1188f962 " with
key a94a8fe5ccb19ba61c4c0873d391e987982fbbd3 in
section 4.2.1 and figure 7-3
scores 3-2 and 10-8 and 21-19
see you at 5 at home
we met at noon at the dot of the map
look at example for details
the game ended 101-99 at last
isbn 978-3-16-148410-0 of the book
call 911 now
from 100 to 2000 people
flight 447 at 23:55 gate 12
a ratio of 3.14159 at 20.5 degrees
@ home with the team
follow @name on the site
def f(x): return x[0] + y[1] @ z
zip 94107 and box 1234
phone 2.0 is out, version 12
mail 3 letters at once
item 555-0134 of the list
"""
_MARKUP = re.compile(r"\{\{(\w+):(.*?)\}\}")
#: Words that the features name; any other word is known by its shape alone.
CONTEXT = frozenset("at dot punkt punto point call phone tel telefon tél teléfono mobile cell fax text number email mail e write contact reach send address ip host server card".split())
#: What makes a neighbourhood worth decoding, and the white-space-separated words on either side of it.
_TRIGGER = re.compile(r"[0-9@]|\b(?:at|dot|punkt|punto|point)\b|[\[(](?:at|dot)[\])]", re.IGNORECASE)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\s]")
_OUTSIDE = re.compile(r"\S+")
SIDE = 3
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]


def shape(token):
    """A coarse shape: digits by their number, small words by name, others by case and length, marks as themselves."""
    c = token[0]
    if c in "0123456789":
        return f"9{len(token) if len(token) < 5 else '5-8' if len(token) < 9 else '9-13' if len(token) < 14 else '14+'}"
    if c.isalpha():
        low = token.lower()
        return low if low in CONTEXT else ("a" if token.islower() else "A") + ("1" if len(token) == 1 else "+")
    return c if ord(c) < 128 else "*"


def tokens_of(text, lo, hi):
    """(start, end, shape with a sign for white space before it) of the tokens in ``text[lo:hi]``."""
    out, before = [], lo
    for m in _TOKEN.finditer(text, lo, hi):
        out.append((m.start(), m.end(), ("_" if m.start() > before or m.start() == lo else "") + shape(m[0])))
        before = m.end()
    return out


def feature_names(shapes, i):
    at = lambda j: shapes[j] if 0 <= j < len(shapes) else "|"
    return (f"0{at(i)}", f"-1{at(i - 1)}", f"+1{at(i + 1)}", f"-2{at(i - 2)}", f"+2{at(i + 2)}", f"-{at(i - 1)} {at(i)}", f"+{at(i)} {at(i + 1)}", f"3{at(i - 1)} {at(i)} {at(i + 1)}", f"4{at(i)} {at(i + 1)} {at(i + 2)}", f"5{at(i - 2)} {at(i - 1)} {at(i)}")


def labelled_rows():
    """(shapes, labels) of each line of the table."""
    for line in LABELLED.strip().split("\n"):
        spans, text, at = [], "", 0
        for m in _MARKUP.finditer(line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        text += line[at:]
        toks = tokens_of(text, 0, len(text))
        labels = ["O"] * len(toks)
        for a, b, kind in spans:
            inside = [i for i, t in enumerate(toks) if a <= t[0] < b]
            for i in inside:
                labels[i] = ("B-" if i == inside[0] else "I-") + kind
        yield [t[2] for t in toks], [LABELS.index(x) for x in labels]


def _logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=1)
def train(rounds=150, rate=0.1, penalty=0.02):
    """(feature -> row of weights, transitions), by Adam on the penalised log-likelihood; forward and backward passes run over
    all rows of the table at once."""
    rows = list(labelled_rows())
    names = sorted({f for s, _ in rows for i in range(len(s)) for f in feature_names(s, i)})
    index, k, n, t = {f: i for i, f in enumerate(names)}, len(LABELS), len(rows), max(len(s) for s, _ in rows)
    used = np.full((n, t, 10), len(names))
    gold, there = np.zeros((n, t), int), np.zeros((n, t), bool)
    for r, (s, y) in enumerate(rows):
        for i in range(len(s)):
            used[r, i] = [index[f] for f in feature_names(s, i)]
            gold[r, i], there[r, i] = y[i], True
    # a span goes on only where one of its kind stands
    allowed = np.array([[not b.startswith("I") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
    ban = np.where(allowed, 0.0, -1e4)
    first = np.array([0.0 if not x.startswith("I") else -1e4 for x in LABELS])
    w, tr = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, tr)]
    for step in range(1, rounds + 1):
        e, a = w[used].sum(axis=2), tr + ban
        alpha, beta = np.empty((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = e[:, 0] + first
        for i in range(1, t):
            alpha[:, i] = np.where(there[:, i, None], _logsum(alpha[:, i - 1, :, None] + a, 1) + e[:, i], alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            beta[:, i] = np.where(there[:, i + 1, None], _logsum(a[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0.0)
        z = _logsum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * there[..., None]
        g = np.zeros_like(w)
        diff = p - np.eye(k)[gold] * there[..., None]
        np.add.at(g, used.reshape(-1, 10), np.repeat(diff.reshape(-1, 1, k), 10, axis=1))
        pair = np.exp(alpha[:, :-1, :, None] + a + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        h = pair.sum(axis=(0, 1))
        np.add.at(h, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), -1.0)
        for p_, grad, (m, v) in ((w, g + penalty * w, moments[0]), (tr, h + penalty * tr, moments[1])):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.999
            v += 0.001 * grad * grad
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[-1] = 0.0
    return {f: w[i] for f, i in index.items()}, tr + ban, first


#: Words times sequences that are decoded together: the table of steps back holds a byte for each and every label.
CELLS = 1 << 20


def viterbi(emissions, transitions, first):
    """Best label path of each sequence; sequences are decoded together, longest first, up to ``CELLS`` words times sequences at once."""
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    paths, at = [None] * len(emissions), 0
    while at < len(order):
        # a long sequence is decoded with few others or alone
        group = order[at : at + max(1, min(1024, CELLS // max(1, len(emissions[order[at]]))))]
        at += len(group)
        lengths = np.array([len(emissions[i]) for i in group])
        k, t = len(first), int(lengths[0])
        back, score = np.zeros((t, len(group), k), np.int8), np.stack([emissions[i][0] for i in group]) + first
        for s in range(1, t):
            live = int(np.searchsorted(-lengths, -s))  # sequences longer than s lead the group
            options = score[:live, :, None] + transitions
            back[s, :live] = options.argmax(axis=1)
            score[:live] = options.max(axis=1) + np.stack([emissions[i][s] for i in group[:live]])
        last = score.argmax(axis=1)
        for r, i in enumerate(group):
            path = [int(last[r])]
            for s in range(int(lengths[r]) - 1, 0, -1):
                path.append(int(back[s, r, path[-1]]))
            paths[i] = path[::-1]
    return paths


def neighbourhoods(text):
    """(start, end) of what is decoded: ``SIDE`` words on either side of every word that holds a trigger, overlaps merged.

    A span holds a digit, an at sign or a word for one; elsewhere the field has nothing to find.
    """
    out, end = [], 0
    m = _TRIGGER.search(text)
    while m:
        lo = m.start()
        for _ in range(SIDE + 1):
            while lo > end and not text[lo - 1].isspace():
                lo -= 1
            stop = lo
            while lo > end and text[lo - 1].isspace():
                lo -= 1
        words = _OUTSIDE.finditer(text, m.start())
        hi = m.end()
        for _, x in zip(range(SIDE + 1), words):
            hi = x.end()
        if out and stop <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((stop, hi))
        end = out[-1][0]
        # the next trigger after this word
        x = _OUTSIDE.match(text, m.start())
        m = _TRIGGER.search(text, max(x.end() if x else m.end(), m.end()))
    return out


def plausible(kind, text):
    digits = len(_DIGIT.findall(text))
    if kind == 0:
        return bool(re.search(r"@|\bat\b|[\[(]at[\])]", text, re.IGNORECASE)) and bool(re.search(r"\.|dot|punkt|punto|point", text, re.IGNORECASE)) and len(text) < 120
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(int(p[:4]) <= 255 for p in parts)
    if kind == 2:
        d = re.sub("[^0-9]", "", text)
        return 14 <= digits <= 19 and luhn(d)
    return 7 <= digits <= 15 and len(text) < 40


class Tagger:
    """Spans of many texts at once. Emissions are kept by the five shapes that decide them."""

    def __init__(self, model):
        self.weights, self.transitions, self.first = model
        self.known = {}

    def emission(self, shapes):
        out = []
        padded = ("|", "|", *shapes, "|", "|")
        zero = np.zeros(len(LABELS))
        for i in range(len(shapes)):
            key = padded[i : i + 5]
            row = self.known.get(key)
            if row is None:
                if len(self.known) > 200_000:
                    self.known.clear()
                row = self.known[key] = sum((self.weights.get(f, zero) for f in feature_names(shapes, i)), zero)
            out.append(row)
        return out

    def extra_spans(self, texts, bases):
        """Spans that the field adds to those of the patterns, for each text."""
        out, where, emissions = [[] for _ in texts], [], []
        for n, text in enumerate(texts):
            for lo, hi in neighbourhoods(text):
                toks = tokens_of(text, lo, hi)
                if toks:
                    where.append((n, toks))
                    emissions.append(self.emission([t[2] for t in toks]))
        for (n, toks), path in zip(where, viterbi(emissions, self.transitions, self.first)):
            i = 0
            while i < len(path):
                label = LABELS[path[i]]
                j = i + 1
                if label[0] == "B":
                    while j < len(path) and LABELS[path[j]] == "I" + label[1:]:
                        j += 1
                    a, b, kind = toks[i][0], toks[j - 1][1], KINDS.index(label[2:])
                    if plausible(kind, texts[n][a:b]) and all(b <= x or a >= y for x, y, _ in bases[n]):
                        out[n].append((a, b, kind))
                i = j
        return out


@lru_cache(maxsize=1)
def tagger():
    return Tagger(train())


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def masked(text, spans):
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans as one, by the first."""
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"<{KINDS[k]}>"]
        end = max(end, b)
    return "".join(out) + text[end:]


def find_pii(docs, id_column="doc_id", text_column="text", keep=(), mask=False):
    """Per row: ``id_column``, the columns of ``keep``, n_email, n_ip, n_card, n_phone (pattern matches), base_sha256, spans (all), and
    the masked text if asked for.

    Null texts count as empty and have no spans; repeated rows each give a row; null ids stay. Offsets are code points.
    """
    fields = [("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())]
    names = [f for f, _ in fields]
    kept = [f"__keep{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, kept)))
    types = dict(rows.dtypes)
    ddl = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", masked string" * mask + "".join(f", {k} {types[k]}" for k in kept)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column("text").to_pylist()
                base = [base_spans(t) for t in texts]
                more = tagger().extra_spans(texts, base)
                every = [sorted(x + y, key=lambda s: (s[0], s[2])) for x, y in zip(base, more)]
                columns = [part.column("id")]
                columns += [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
                columns += [pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base]), pa.array([written(x) for x in every])]
                if mask:
                    columns.append(pa.array([masked(t, x) for t, x in zip(texts, every)], pa.string()))
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(k) for k in kept)], names=[*names, *["masked"] * mask, *kept])

    found = rows.mapInArrow(run, ddl)
    return found.select(F.col("id").alias(id_column), *names[1:], *["masked"] * mask, *(F.col(k).alias(c) for c, k in zip(keep, kept)))


def op10_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
