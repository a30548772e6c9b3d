"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy from labelled spans (generated sentences whose e-mail addresses, IP addresses, card and
phone numbers are known); its parameters are kept in the shared folder. Texts are tagged in overlapping windows; every window is decoded by itself, and
the spans of all windows of a text are reconciled together: what window edges have cut is joined, then the set of spans that do not overlap and have the highest total
score is kept. Every kind holds a digit or an @ sign, so windows without either have nothing to find and are not decoded.

Defined results: null and empty texts have no spans; offsets are code points; repeated rows are scanned alike; very long
texts are scanned whole in time linear in their length; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import shared_dir
from lectern.llm.spans import Span, Taken, scan

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Windows decoded at once.
_BATCH = 512

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    doubled = [int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _emails(text: str) -> list[Span]:
    """By the @ signs, left to right, in linear time."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    found = _emails(text)
    if not any(map(text.__contains__, "0123456789")):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# ---- labelled spans ----

_SYLLABLES = "th an er re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()


def _word(r: random.Random) -> str:
    word = "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))
    return (word.capitalize() if r.random() < 0.1 else word) + (r.choice(",.;:!?") if r.random() < 0.1 else "")


def _digits(r: random.Random, n: int) -> str:
    return f"{r.randrange(10**n):0{n}d}"


def _card(r: random.Random) -> str:
    body = r.choice("3456") + _digits(r, r.choice((13, 14, 14)))
    digits = next(body + c for c in "0123456789" if luhn(body + c))
    return r.choice(("", " ", "-")).join(re.findall(".{1,4}", digits))


def _phone(r: random.Random, without: frozenset[str]) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    forms = {"+1 (a) b-c": f"+1 ({a}) {b}-{c}", "(a) b-c": f"({a}) {b}-{c}", "a-b-c": f"{a}-{b}-{c}", "a.b.c": f"{a}.{b}.{c}", "0a b c": f"0{a} {b} {c}", "+n a b c": f"+{_digits(r, 2)} {a} {b} {c}", "00n a bc": f"00{_digits(r, 2)} {a} {b}{c}"}
    return r.choice([form for name, form in forms.items() if name not in without])


def _email(r: random.Random, without: frozenset[str]) -> str:
    name, host = _word(r).strip(",.;:!?"), _word(r).strip(",.;:!?").lower()
    ats = [at for at in ("@", "@", " @ ", "(@)") if at not in without]
    return name + r.choice(("", ".", "_", "")) + r.choice((_digits(r, 2), "", _word(r).strip(",.;:!?"))) + r.choice(ats) + host + r.choice(("", _digits(r, 1))) + r.choice((".com", ".org", ".co.uk", ".example.com"))


def _ip(r: random.Random) -> str:
    return ".".join(str(r.randint(0, 255)) for _ in range(4))


def _other(r: random.Random) -> str:
    return r.choice((f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(0, 99)}.{_digits(r, 2)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", _digits(r, r.randint(1, 7)), "%0*x" % (r.choice((32, 40)), r.getrandbits(128)), f"#{_digits(r, 4)}", f"{r.randint(1, 23)}:{_digits(r, 2)}", f"{_word(r)}{_digits(r, 2)}", f"{r.randint(1, 999)},{_digits(r, 3)}", f"@{_word(r)}", f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", _digits(r, r.randint(20, 30)), f"ISBN {_digits(r, 3)}-{_digits(r, 1)}-{_digits(r, 5)}"))


def labelled(r: random.Random, length: int = WINDOW, without: frozenset[str] = frozenset()) -> tuple[str, list[Span]]:
    """A text of the given length with its spans; each kind is as likely as a number that is none. without: forms of phone numbers and signs of addresses that are left out."""
    text, spans = "", []
    makers = {"email": lambda r: _email(r, without), "ip": _ip, "card": _card, "phone": lambda r: _phone(r, without)}
    while len(text) < length:
        text += "".join(_word(r) + " " for _ in range(r.randint(0, 5)))
        kind = r.choice((*KINDS, None, None))
        made = makers[kind](r) if kind else _other(r)
        if kind and len(text) + len(made) <= length:
            spans.append((kind, len(text), len(text) + len(made)))
        elif kind:
            continue
        text += made + r.choice((" ", " ", ", ", ". ", "\n", "### ", "; "))
    return text[:length], spans


# ---- the tagger ----

_TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
#: Characters known one by one; a letter is known by its class, so that the tagger cannot learn the words around.
_ALPHABET = " \n0123456789@.-+()_%:/#,;=\"'"


def codes(text: str) -> np.ndarray:
    return np.array([_CODE.get(c) or (1 if c.islower() else 2 if c.isupper() else 3) for c in text], dtype=np.int64)


_CODE = {c: i + 4 for i, c in enumerate(_ALPHABET)}
_N_CODES = 4 + len(_ALPHABET)
_EMBED, _HIDDEN = 16, 24


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Both directions at once. x: (2, T, N, E), of which the second runs backwards -> hidden states (2, T, N, H) and what backpropagation needs."""
    ways, steps, n, _ = x.shape
    size = u.shape[1]
    into = (x.reshape(ways, steps * n, -1) @ w + b[:, None, :]).reshape(ways, steps, n, 4 * size)
    into[..., size : 2 * size] += 1  # the forget gate starts open
    gates, news = np.empty((ways, steps, n, 3 * size), x.dtype), np.empty((ways, steps, n, size), x.dtype)
    cells, states = np.zeros((ways, steps + 1, n, size), x.dtype), np.zeros((ways, steps + 1, n, size), x.dtype)
    for t in range(steps):
        z = into[:, t] + states[:, t] @ u
        gates[:, t], news[:, t] = _sigmoid(z[..., : 3 * size]), np.tanh(z[..., 3 * size :])
        cells[:, t + 1] = gates[:, t, :, size : 2 * size] * cells[:, t] + gates[:, t, :, :size] * news[:, t]
        states[:, t + 1] = gates[:, t, :, 2 * size :] * np.tanh(cells[:, t + 1])
    return states[:, 1:], (gates, news, cells, states)


def _lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: tuple, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    gates, news, cells, states = kept
    ways, steps, n, size = news.shape
    through = np.tanh(cells[:, 1:])
    i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
    # What a change of the cell, or of the output gate, makes of each gate's sum.
    of_cell = np.concatenate([news * i * (1 - i), cells[:, :-1] * f * (1 - f), np.zeros_like(o), i * (1 - news * news)], axis=3)
    of_out, into_cell = through * o * (1 - o), o * (1 - through * through)
    z, back = np.empty_like(of_cell), u.transpose(0, 2, 1)
    dh, dc = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
    for t in reversed(range(steps)):
        dh = dh + grad[:, t]
        dc = dc + dh * into_cell[:, t]
        z[:, t] = np.concatenate([dc, dc, dc, dc], axis=2) * of_cell[:, t]
        z[:, t, :, 2 * size : 3 * size] = dh * of_out[:, t]
        dh, dc = z[:, t] @ back, dc * f[:, t]
    flat = z.reshape(ways, steps * n, -1)
    dw = x.reshape(ways, steps * n, -1).transpose(0, 2, 1) @ flat
    du = states[:, :-1].reshape(ways, steps * n, -1).transpose(0, 2, 1) @ flat
    return dw, du, flat.sum(axis=1), (flat @ w.transpose(0, 2, 1)).reshape(x.shape)


def _crf(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (T, N, K) and expected transitions (K, K) summed over all, by forward and backward sums scaled at each step."""
    likely = np.exp(scores - scores.max(axis=2, keepdims=True))
    ways = np.exp(trans - trans.max())
    ahead, behind, scale = np.empty_like(likely), np.ones_like(likely), np.empty(likely.shape[:2] + (1,), likely.dtype)
    for t in range(len(scores)):
        ahead[t] = likely[t] if t == 0 else (ahead[t - 1] @ ways) * likely[t]
        scale[t] = ahead[t].sum(axis=1, keepdims=True)
        ahead[t] /= scale[t]
    for t in reversed(range(len(scores) - 1)):
        behind[t] = (likely[t + 1] * behind[t + 1] / scale[t + 1]) @ ways.T
    after = likely[1:] * behind[1:] / scale[1:]
    k = len(trans)
    return ahead * behind, (ahead[:-1].reshape(-1, k).T @ after.reshape(-1, k)) * ways


def _states(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """What goes into the LSTM, its states side by side, the tags' scores, and what backpropagation needs. x: codes (T, N)."""
    embedded = p["e"][x]
    into = np.stack([embedded, embedded[::-1]])
    out, kept = _lstm(into, p["w"], p["u"], p["b"])
    both = np.concatenate([out[0], out[1, ::-1]], axis=2)
    return into, both, both @ p["v"] + p["c"], kept


def gradients(p: dict[str, np.ndarray], x: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-likelihood of the tags. x, tags: (T, N)."""
    k, batch = len(_TAGS), x.shape[1]
    into, both, scores, kept = _states(p, x)
    marginal, pairs = _crf(scores, p["t"])
    d = (marginal - np.eye(k, dtype=scores.dtype)[tags]) / batch
    g = {"t": pairs / batch, "v": both.reshape(-1, 2 * _HIDDEN).T @ d.reshape(-1, k), "c": d.sum(axis=(0, 1))}
    np.add.at(g["t"], (tags[:-1].ravel(), tags[1:].ravel()), -1.0 / batch)
    back = d @ p["v"].T
    g["w"], g["u"], g["b"], dx = _lstm_back(into, p["w"], p["u"], kept, np.stack([back[:, :, :_HIDDEN], back[::-1, :, _HIDDEN:]]))
    g["e"] = np.zeros_like(p["e"])
    np.add.at(g["e"], x, dx[0] + dx[1, ::-1])
    return g


@functools.lru_cache(maxsize=2)
def trained(steps: int = 400, batch: int = 48, length: int = 64, seed: int = 7, without: frozenset[str] = frozenset()) -> dict[str, np.ndarray]:
    """The tagger's parameters; the same for the same arguments. The labelled sample is steps * batch texts, none with the forms of without."""
    r, rng = random.Random(seed), np.random.default_rng(seed)
    k = len(_TAGS)
    shapes = {"e": (_N_CODES, _EMBED), "w": (2, _EMBED, 4 * _HIDDEN), "u": (2, _HIDDEN, 4 * _HIDDEN), "v": (2 * _HIDDEN, k)}
    p = {n: rng.normal(0, 1 / np.sqrt(s[-2]), s).astype(np.float32) for n, s in shapes.items()}
    p |= {n: np.zeros(s, np.float32) for n, s in {"b": (2, 4 * _HIDDEN), "c": k, "t": (k, k)}.items()}
    first, second = {n: np.zeros_like(a) for n, a in p.items()}, {n: np.zeros_like(a) for n, a in p.items()}
    for step in range(1, steps + 1):
        made = [labelled(r, length, without) for _ in range(batch)]
        x = np.stack([codes(t) for t, _ in made], axis=1)
        tags = np.zeros((length, batch), dtype=np.int64)
        for n, (_, spans) in enumerate(made):
            for kind, start, end in spans:
                tags[start:end, n] = _TAGS.index(f"I-{kind}")
                tags[start, n] = _TAGS.index(f"B-{kind}")
        g = gradients(p, x, tags)
        rate = 0.02 * min(1.0, step / 20) * (0.1 ** (step / steps))
        for n in p:
            grad = np.clip(g[n], -5, 5)
            first[n] = 0.9 * first[n] + 0.1 * grad
            second[n] = 0.999 * second[n] + 0.001 * grad * grad
            p[n] = (p[n] - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def kept_parameters(spark: SparkSession, **how: object) -> dict[str, np.ndarray]:
    """trained(**how), from the shared folder if a session has left it there: by the arguments and this module's text, so that other code trains anew."""
    key = hashlib.sha256(repr(sorted(how.items())).encode() + Path(__file__).read_bytes()).hexdigest()[:24]
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pii-{key}-*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    if found:
        rows = spark.read.parquet(found[0].getPath().getParent().toString()).collect()
        return {r["name"]: np.array(r["numbers"], dtype=np.float32).reshape(r["shape"]) for r in rows}
    p = trained(**how)
    rows = [(n, list(a.shape), a.ravel().tolist()) for n, a in p.items()]
    # A folder of its own: another session that trains at the same time is not in the way.
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<float>").coalesce(1).write.parquet(f"{shared_dir(spark)}/pii-{key}-{uuid.uuid4().hex}")
    return p


def decoded(p: dict[str, np.ndarray], windows: list[str]) -> list[list[tuple[float, Span]]]:
    """Spans of each window with their scores, by Viterbi. The score of a span is its length times its mean margin over O."""
    length = max(map(len, windows))
    x = np.stack([np.pad(codes(w), (0, length - len(w)), constant_values=4) for w in windows], axis=1)
    _, _, scores, _ = _states(p, x)
    best, came = scores[0], []
    for t in range(1, length):
        ways = best[:, :, None] + p["t"][None]
        came.append(ways.argmax(axis=1))
        best = scores[t] + ways.max(axis=1)
    path = np.empty((length, len(windows)), dtype=np.int64)
    path[-1] = best.argmax(axis=1)
    for t in reversed(range(length - 1)):
        path[t] = came[t][np.arange(len(windows)), path[t + 1]]
    out = []
    for n, window in enumerate(windows):
        spans, at = [], 0
        while at < len(window):
            if path[at, n] == 0:
                at += 1
                continue
            kind, end = (path[at, n] - 1) // 2, at + 1
            while end < len(window) and path[end, n] == 2 + 2 * kind:
                end += 1
            margin = float(np.mean(scores[np.arange(at, end), n, path[at:end, n]] - scores[at:end, n, 0]))
            spans.append((margin * (end - at), (KINDS[kind], at, end)))
            at = end
        out.append(spans)
    return out


def plausible(span: Span, text: str) -> bool:
    """The span has what its kind must have; digits in plenty also stand in things that are nobody's."""
    body = text[span[1] : span[2]]
    if text[max(0, span[1] - 1) : span[1]].isdigit() or text[span[2] : span[2] + 1].isdigit():
        return False  # part of a longer number
    digits = sum(c.isdigit() for c in body)
    if span[0] == "email":
        return "@" in body and "." in body.rpartition("@")[2]
    if span[0] == "ip":
        return bool(_IP.fullmatch(body))
    if span[0] == "card":
        return 12 <= digits <= 19 and luhn("".join(c for c in body if c.isdigit()))
    return 9 <= digits <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", body)) and len(re.findall(r"[0-9]+", body)) >= 3


def reconciled(candidates: list[tuple[float, Span]]) -> list[Span]:
    """Of all windows' spans, those that do not overlap and have the highest total score."""
    best: dict[Span, float] = {}
    for score, span in candidates:
        best[span] = max(score, best.get(span, score))
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    totals, chosen = [0.0], []
    for n, span in enumerate(spans):
        free = bisect.bisect_right(spans, span[1], hi=n, key=lambda s: s[2])
        take = totals[free] + max(0.0, best[span])
        chosen.append((take > totals[-1], free))
        totals.append(max(totals[-1], take))
    out, n = [], len(spans)
    while n:
        taken, free = chosen[n - 1]
        if taken:
            out.append(spans[n - 1])
        n = free if taken else n - 1
    return out[::-1]


def mended(parts: list[tuple[str, int, int, bool, bool, float]]) -> list[tuple[float, Span]]:
    """Spans from parts (kind, start, end, cut off at the left, at the right, score) that windows have cut off: overlapping parts of a kind are joined, if the whole has both its ends."""
    out: list[tuple[float, Span]] = []
    held: list | None = None

    def close() -> None:
        if held and not held[3] and not held[4]:
            out.append((held[5], (held[0], held[1], held[2])))

    for kind, start, end, left, right, score in sorted(parts):
        if held and held[0] == kind and start < held[2]:
            held[3] = held[3] and not (start == held[1] and not left)
            if end >= held[2]:
                held[4] = right if end > held[2] else held[4] and right
                held[2] = end
            held[5] = max(held[5], score)
        else:
            close()
            held = [kind, start, end, left, right, score]
    close()
    return out


def further_spans(p: dict[str, np.ndarray], texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """What the tagger finds besides the base spans."""
    asked: list[tuple[int, int]] = []
    for n, text in enumerate(texts):
        starts = set()
        for m in _MARK.finditer(text):
            starts.update(s for s in ((m.start() // STRIDE - 1) * STRIDE, m.start() // STRIDE * STRIDE) if s >= 0)
        asked += [(n, s) for s in sorted(starts)]
    found: list[list[tuple[float, Span]]] = [[] for _ in texts]
    torn: list[list[tuple[str, int, int, bool, bool, float]]] = [[] for _ in texts]
    for at in range(0, len(asked), _BATCH):
        part = asked[at : at + _BATCH]
        for (n, start), spans in zip(part, decoded(p, [texts[n][s : s + WINDOW] for n, s in part]), strict=True):
            for score, (kind, a, b) in spans:
                left, right = a == 0 and start > 0, b == WINDOW and start + WINDOW < len(texts[n])
                if left or right:
                    torn[n].append((kind, start + a, start + b, left, right, score))
                else:
                    found[n].append((score, (kind, start + a, start + b)))
    for n, parts in enumerate(torn):
        found[n] += mended(parts)
    out = []
    for text, base, candidates in zip(texts, bases, found, strict=True):
        taken = Taken(base)
        out.append([s for s in reconciled([c for c in candidates if plausible(c[1], text)]) if not taken.overlaps(s[1], s[2])])
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    model = docs.sparkSession.sparkContext.broadcast(kept_parameters(docs.sparkSession))

    def finder(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        bases = [base_spans(t) for t in texts]
        return list(zip(bases, further_spans(model.value, texts, bases), strict=True))

    return scan(docs, id_col, text_col, KINDS, KINDS, finder)
