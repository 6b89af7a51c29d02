"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans (written by `labelled_windows`, with a fixed
seed). A text is cut into overlapping windows that cover it all, and every window is decoded by
Viterbi. Spans are reconciled over the whole text: a span within one window counts where that
window's centre is the nearest to its middle, and parts cut at window edges are joined with those
of the next window. The network decides by itself what it adds: a span stays if its probability
under the CRF (all paths that have just this span there) is at least `least`, if it has as many
digits as its kind can have (a card's pass the Luhn check; an address has an at-sign or an "at"),
and if it cuts no word.

Spans of the patterns always stay; the network adds spans that overlap none of them.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.session import ready

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start.

    Emails grow backwards from each "@", which finds what the leftmost match would find but in
    linear time on long runs of name characters.
    """
    out: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the network ---------------------------------------------------------------------------

WINDOW, OVERLAP = 320, 32
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
SYMBOLS = 100
EMBED, HIDDEN = 12, 10
#: Training: windows made, their width, Adam steps, windows in a step, and the first rate.
MADE, TRAINED, STEPS, BATCH, RATE = 16000, 128, 2200, 48, 0.03
#: Probability from which on a decoded span is added.
LEAST = 0.9
#: Windows scored side by side, and windows that may hold spans searched together, about.
SIDE_BY_SIDE, SEARCHED = 512, 256
#: Digits that a kind has at least and at most.
DIGITS = {"email": (0, 64), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}


def symbols(text: str) -> np.ndarray:
    """Symbol of each code point: printable ASCII as such, then white space, letters, the rest."""
    out = np.empty(len(text), np.uint8)
    for at in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), "<u4")
        part = np.where((codes >= 0x20) & (codes < 0x7F), codes - 0x1F, np.where(codes >= 0xC0, 97, 98))
        part[(codes == 9) | (codes == 10) | (codes == 13)] = 96
        out[at : at + len(codes)] = part
    return out


def _cells(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Input by symbol (2, 4H, symbols) and recurrent weights (2, 4H, H), gates halved for tanh."""
    half = np.repeat(np.array([0.5, 0.5, 0.5, 1], np.float32), HIDDEN)[:, None]
    return (np.matmul(p["W"], p["E"].T) + p["B"]) * half, p["U"] * half


def _forward(p: dict, x: np.ndarray, keep: bool):
    """Tag scores (time, tags, batch) of symbol windows (batch, time), forward and backward cells side by side.

    A step's arrays are (direction, gates or cells, batch); the logistic function is taken from tanh.
    """
    n, width = x.shape
    table, u = _cells(p)
    h, c = np.zeros((2, HIDDEN, n), np.float32), np.zeros((2, HIDDEN, n), np.float32)
    (z, given), rows = np.empty((2, 2, 4 * HIDDEN, n), table.dtype), []
    hs = np.empty((width, 2 * HIDDEN, n), table.dtype)
    turned = np.ascontiguousarray(x.T).astype(np.intp)
    for t in range(width):
        np.matmul(u, h, out=z)
        np.take(table[0], turned[t], axis=1, out=given[0], mode="clip")
        np.take(table[1], turned[width - 1 - t], axis=1, out=given[1], mode="clip")
        z += given
        np.tanh(z, out=z)
        gates, g = z[:, : 3 * HIDDEN], z[:, 3 * HIDDEN :]
        gates *= 0.5
        gates += 0.5
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            rows.append((h, before, z, tc))
            z = np.empty_like(z)
        h = o * tc
        hs[t, :HIDDEN], hs[width - 1 - t, HIDDEN:] = h[0], h[1]
    return np.matmul(p["V"].T, hs) + p["C"][:, None], (hs, rows, turned)


def _sums(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log sums over paths up to each time and tag (alpha), from there on (beta), and over all."""
    width, k, n = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    there, back = np.exp(trans.T), np.exp(trans)
    alpha[0] = scores[0]
    for t in range(1, width):
        top = alpha[t - 1].max(axis=0)
        alpha[t] = np.log(there @ np.exp(alpha[t - 1] - top) + 1e-30) + top + scores[t]
    for t in range(width - 2, -1, -1):
        on = beta[t + 1] + scores[t + 1]
        top = on.max(axis=0)
        beta[t] = np.log(back @ np.exp(on - top) + 1e-30) + top
    top = alpha[-1].max(axis=0)
    return alpha, beta, np.log(np.exp(alpha[-1] - top).sum(axis=0)) + top


def _crf(scores: np.ndarray, trans: np.ndarray, tags: np.ndarray):
    """Loss of the CRF and its gradients by scores and transitions."""
    width, k, n = scores.shape
    alpha, beta, log_z = _sums(scores, trans)
    gold = np.zeros_like(scores)
    np.put_along_axis(gold, tags.T[:, None, :], 1, axis=1)
    d_scores = np.exp(alpha + beta - log_z) - gold
    pairs = np.zeros((k, k), np.float64)
    for t in range(1, width):
        top = alpha[t - 1].max(axis=0)
        pairs += np.exp(alpha[t - 1] - top) @ np.exp(scores[t] + beta[t] + top - log_z).T
    told = np.matmul(gold[:-1], gold[1:].transpose(0, 2, 1)).sum(axis=0)
    loss = log_z.sum() - (gold * scores).sum() - (told * trans).sum()
    return float(loss) / n, d_scores / n, ((pairs * np.exp(trans) - told) / n).astype(np.float32)


def _backward(p: dict, d_scores: np.ndarray, kept) -> dict:
    """Gradients by all weights but the transitions."""
    hs, rows, turned = kept
    width, _, n = d_scores.shape
    g = {"V": np.matmul(hs, d_scores.transpose(0, 2, 1)).sum(axis=0), "C": d_scores.sum(axis=(0, 2))}
    d_hs = np.matmul(p["V"], d_scores)
    d_h, d_c = np.zeros((2, HIDDEN, n), np.float32), np.zeros((2, HIDDEN, n), np.float32)
    d_z = np.empty((width, 2, 4 * HIDDEN, n), np.float32)
    g["U"] = np.zeros_like(p["U"])
    for t in range(width - 1, -1, -1):
        h, before, z, tc = rows[t]
        i, f, o, a = (z[:, j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
        d_h[0] += d_hs[t, :HIDDEN]
        d_h[1] += d_hs[width - 1 - t, HIDDEN:]
        d_c += d_h * o * (1 - tc * tc)
        d = d_z[t]
        d[:, :HIDDEN] = d_c * a * i * (1 - i)
        d[:, HIDDEN : 2 * HIDDEN] = d_c * before * f * (1 - f)
        d[:, 2 * HIDDEN : 3 * HIDDEN] = d_h * tc * o * (1 - o)
        d[:, 3 * HIDDEN :] = d_c * i * (1 - a * a)
        g["U"] += np.matmul(d, h.transpose(0, 2, 1))
        d_h = np.matmul(p["U"].transpose(0, 2, 1), d)
        d_c = d_c * f
    g["B"] = d_z.sum(axis=(0, 3))[:, :, None]
    d_table = []
    for side, order in enumerate((turned, turned[::-1])):
        hot = np.zeros((width * n, SYMBOLS), np.float32)
        hot[np.arange(width * n), order.ravel()] = 1
        d_table.append(d_z[:, side].transpose(1, 0, 2).reshape(4 * HIDDEN, -1) @ hot)
    g["W"] = np.stack([d @ p["E"] for d in d_table])
    g["E"] = sum(d.T @ w for d, w in zip(d_table, p["W"], strict=True))
    return g


def labelled_text(rnd: random.Random, length: int, rate: float) -> tuple[str, list[int]]:
    """A made-up text of at least `length` code points with its tags: personal data in and beyond the
    fixed patterns for a share `rate` of its pieces, and words, numbers and marks that are none."""
    syllables = "er en ch de ei in te la on ment tion qui re un au ou al ar es ado os el que th ing of the and to is ly wh un ge st sch ve ê é ö ü ñ á ç ß i a o at hat to tz an and".split()

    def word(lo=1, hi=4):
        w = "".join(rnd.choice(syllables) for _ in range(rnd.randint(lo, hi)))
        if rnd.random() < 0.4:  # letters of no language
            w = "".join(rnd.choice("aeiouyeaiouxzqwkjvbcdfghlmnprstéèêàâîôûçœëïüöäßñóíáú") for _ in range(rnd.randint(1, 12)))
        return rnd.choice([w, w, w, w, w.capitalize(), w.upper()])

    def plain(lo=1, hi=4):
        return "".join(c for c in word(lo, hi) if c.isascii()) or "ann"

    def digits(k):
        return "".join(rnd.choice("0123456789") for _ in range(k))

    def split(s, sizes, mark):
        out, at = [], 0
        for k in sizes:
            out.append(s[at : at + k])
            at += k
        return mark.join(out)

    def email():
        name = rnd.choice([f"{plain()}.{digits(rnd.randint(1, 3))}", f"{plain()}_{plain()}", f"{plain()}.{plain()}", plain(), f"{plain()}{digits(2)}", f"{plain()}-{plain()}", f"{plain()}+{plain()}"])
        host = [rnd.choice(["mail", "post", "web", "corp", plain()]) + rnd.choice(["", "", digits(1)]), rnd.choice(["example", "test", "demo", plain()]), rnd.choice(["com", "org", "net", "de", "fr", "es", "io"])]
        if rnd.random() < 0.5:
            del host[0]
        at, dot = rnd.choice([("@", "."), ("@", "."), ("@", "."), (" @ ", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", "."), ("@", "[.]")])
        return name + at + dot.join(host)

    def ip():
        parts = [str(rnd.randint(0, 255)) for _ in range(4)]
        return rnd.choice([".", ".", ".", "[.]", " . ", "(.)", "[dot]"]).join(parts)

    def card():
        body = rnd.choice("3456") + digits(14)
        check = next(c for c in "0123456789" if luhn(body + c))
        s = body + check
        mark = rnd.choice(["", " ", " ", "-", "-", ".", "  ", "/", "_", " - "])
        if rnd.random() < 0.85:
            return split(s, (4, 4, 4, 4), mark)
        return split(body[:14] + next(c for c in "0123456789" if luhn(body[:14] + c)), (4, 6, 5), mark)

    def phone():
        a, b, c, land = digits(3), digits(3), digits(4), str(rnd.randint(1, 99))
        m = rnd.choice(" .-")
        return rnd.choice([
            f"+{land} ({a}) {b}-{c}", f"+{land} {a} {b} {c}", f"+{land}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}{m}{b}{m}{c}", f"00{land} {digits(2)} {digits(rnd.randint(6, 8))}",
            f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(1)}", f"0{digits(rnd.randint(2, 4))}/{digits(rnd.randint(5, 8))}", f"+{land} {digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"({a}){m}{b}{m}{c}",
        ])

    def other():
        hexa = "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice([8, 12, 18, 32, 40])))
        day = f"{rnd.randint(1, 28):02d}"
        month = f"{rnd.randint(1, 12):02d}"
        return rnd.choice([
            digits(rnd.randint(1, 7)), f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"20{digits(2)}-{month}-{day}", f"{day}.{month}.20{digits(2)}", f"{day}/{month}/{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}",
            f"20{digits(2)}-{month}-{day}T{digits(2)}:{digits(2)}:{digits(2)}Z", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(1)}.", f"{digits(1)}.{digits(1)}.", f"{digits(1)},{digits(3)},{digits(3)}", f"{digits(2)} {digits(3)}", f"{digits(1)}.{digits(3)}.{digits(3)},{digits(2)}",
            f'"{hexa}"', f"password={hexa}", f"key_{hexa}", f"sk-{hexa.upper()}", f"@{plain()}", f"@{plain()} {plain()}", f"{plain()} @ {digits(2)}", f"({digits(4)})", f"{digits(2)}%", f"${digits(3)}.{digits(2)}", f"{word()}{digits(2)}", hexa.upper(), hexa,
            digits(rnd.randint(20, 40)), f"{digits(3)}-{digits(4)}", f"{digits(5)}-{digits(4)}", f"{digits(3)}-{digits(2)}", f"{word()}$$$ {word()}### {word()}***", "#" * rnd.randint(3, 9), "=" * rnd.randint(3, 20), "-" * rnd.randint(3, 20), "!!", "%%%",
            f"http://{plain()}.{plain()}/{plain()}?{plain()}={digits(2)}", f"www.{plain()}.com", f"{plain()}.{plain()}.com", f"{plain()} at {plain()} dot", f"at {plain()}", f"({plain()})", f"[{plain()}]", f"[{digits(1)}]", f"<{plain()}>", f"</{plain()}>", f"{plain()}={digits(3)};",
            f"{plain()}_{plain()}()", f"{plain()}.{plain()}", f"{plain()}, {plain()}.", f"pp. {digits(3)}-{digits(3)}", f"{digits(4)}-{digits(4)}", f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(2)}x{digits(2)}", f"{digits(3)} {plain()} {digits(2)}", f"Copyright (c) 20{digits(2)} {word()}",
            f"300.{digits(3)}.{rnd.randint(256, 999)}.{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(2)}", f"{digits(4)} {digits(4)}", f"{digits(4)}-{digits(2)}", f"{digits(1)}/{digits(1)}", f"{digits(8)}", f"{plain()}-{digits(6)}", f"id={digits(10)}", f"#{digits(9)}", f"{digits(1)}e-{digits(2)}", f"-{digits(2)}.{digits(4)}",
        ])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out, size, tags = [], 0, []
    while size < length:
        u = rnd.random()
        kind = rnd.choice(KINDS) if u < rate else "other" if u < rate + 0.15 else None
        piece = word() if kind is None else other() if kind == "other" else makers[kind]()
        gap = rnd.choice([" ", " ", " ", " ", " ", ", ", ". ", "\n", ": ", "; ", "! ", "? ", " (", ") ", ' "', '" ', "%%% ", "###", " | ", "&&& ", "*** "])
        k = 1 + 2 * KINDS.index(kind) if kind in makers else 0
        tags += [k] + [k + 1 if k else 0] * (len(piece) - 1) + [0] * len(gap)
        out += [piece, gap]
        size += len(piece) + len(gap)
    return "".join(out), tags


def labelled_windows(n: int, seed: int, width: int = TRAINED) -> tuple[np.ndarray, np.ndarray]:
    """n windows of made-up text as symbols, with their tags."""
    rnd = random.Random(seed)
    xs, ys = np.zeros((n, width), np.uint8), np.zeros((n, width), np.int64)
    for row in range(n):
        text, tags = labelled_text(rnd, width + 60, rnd.choice([0.0, 0.1, 0.3]))
        cut = rnd.choice([0, rnd.randint(0, 59)])
        xs[row], ys[row] = symbols(text)[cut : cut + width], tags[cut : cut + width]
        if rnd.random() < 0.3:  # the end of a text, and the padding behind it
            end = rnd.randint(1, width)
            while 0 < end < width and ys[row, end] and ys[row, end] % 2 == 0:
                end += 1
            xs[row, end:], ys[row, end:] = 0, 0
    return xs, ys


@lru_cache(maxsize=2)
def train(seed: int = 7, steps: int = STEPS) -> dict:
    """Weights after `steps` Adam steps on made-up windows; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    shapes = {"E": (SYMBOLS, EMBED), "W": (2, 4 * HIDDEN, EMBED), "U": (2, 4 * HIDDEN, HIDDEN), "B": (2, 4 * HIDDEN, 1), "V": (2 * HIDDEN, TAGS), "C": (TAGS,), "T": (TAGS, TAGS)}
    p = {k: (rng.standard_normal(s) * (0 if k in "BCT" else 0.5 / np.sqrt(s[-1] if k in "WU" else s[0]))).astype(np.float32) for k, s in shapes.items()}
    p["E"] *= 4
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    xs, ys = labelled_windows(MADE, seed)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(xs), BATCH)
        scores, kept = _forward(p, xs[rows], True)
        _, d_scores, d_trans = _crf(scores, p["T"], ys[rows])
        g = _backward(p, d_scores, kept) | {"T": d_trans}
        size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = RATE * (1 - 0.95 * step / steps)
        for k in p:
            a = g[k] * min(1.0, 5.0 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


def _viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (batch, time)."""
    width, k, n = scores.shape
    best, back = scores[0], np.empty((width, k, n), np.int8)
    for t in range(1, width):
        m = best[:, None, :] + trans[:, :, None]
        back[t] = m.argmax(axis=0)
        best = m.max(axis=0) + scores[t]
    out = np.empty((n, width), np.int64)
    out[:, -1] = best.argmax(axis=0)
    rows = np.arange(n)
    for t in range(width - 1, 0, -1):
        out[:, t - 1] = back[t][out[:, t], rows]
    return out


def _windows(length: int) -> list[tuple[int, int]]:
    """(start, width) of the windows of a text; the last one's width is rounded up to 32."""
    if not length:
        return []
    starts = list(range(0, max(1, length - OVERLAP), WINDOW - OVERLAP))
    return [(a, min(WINDOW, -(-(length - a) // 32) * 32)) for a in starts]


def _worth_search(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Windows whose best path may leave tag 0.

    An excursion from the path of zeros is followed by kind, with the best of its possible steps:
    if none gains anything in all, zeros are the best path.
    """
    width = len(scores)
    k = np.arange(1, TAGS, 2)
    own = trans[1:, 1:]
    cross = np.array([np.delete(trans[1:, 1 + 2 * i + 1], [2 * i, 2 * i + 1]).max() for i in range(len(k))])[:, None]
    rest = scores[:, :1] + trans[0, 0]
    begin, inner = scores[:, k] - rest, scores[:, k + 1] - rest
    enter = np.maximum(begin + trans[0, k][:, None], inner + trans[0, k + 1][:, None])
    enter[0] = np.maximum(begin[0], inner[0]) + trans[0, 0]
    on = inner + np.maximum(trans[k, k + 1], trans[k + 1, k + 1])[:, None]
    turn = np.maximum(begin + own[:, k - 1].max(axis=0)[:, None], inner + cross)
    leave = (np.maximum(trans[k, 0], trans[k + 1, 0]) - trans[0, 0])[:, None]
    gain = enter[0]
    most = (gain + (leave if width > 1 else 0)).max(axis=0)
    for t in range(1, width):
        gain = np.maximum(np.maximum(enter[t], on[t] + gain), turn[t] + gain.max(axis=0))
        most = np.maximum(most, (gain + (leave if t < width - 1 else 0)).max(axis=0))
    return np.flatnonzero(most >= -1e-3)


def _found(scores: np.ndarray, trans: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(window, first, last, kind, log probability) of the spans in the best paths of windows (time, tags, windows)."""
    width, out = len(scores), []
    paths = _viterbi(scores, trans)
    inside = np.flatnonzero(paths.any(axis=1))
    if not len(inside):
        return out
    mine, paths = scores[:, :, inside].astype(np.float64), paths[inside]
    alpha, beta, log_z = _sums(mine, trans.astype(np.float64))
    for j, tags in enumerate(paths):
        marks = np.flatnonzero(tags)
        i = 0
        while i < len(marks):
            a = b = int(marks[i])
            kind = int(tags[a] - 1) // 2
            inner = 2 * kind + 2
            while b + 1 < width and tags[b + 1] == inner:
                b += 1
            value = alpha[a, tags[a], j] + sum(trans[tags[t - 1], inner] + mine[t, inner, j] for t in range(a + 1, b + 1))
            if b + 1 < width:
                on = trans[tags[b]] + mine[b + 1, :, j] + beta[b + 1, :, j]
                on[inner] = -np.inf
                value += np.logaddexp.reduce(on)
            out.append((int(inside[j]), a, b, kind, float(value - log_z[j])))
            i = int(np.searchsorted(marks, b, "right"))
    return out


def _spans_of(weights: dict, x: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """_found of symbol windows (windows, time), scored side by side; those worth a search are searched together."""
    held: list[np.ndarray] = []
    places: list[int] = []
    for lo in range(0, len(x), SIDE_BY_SIDE):
        scores, _ = _forward(weights, x[lo : lo + SIDE_BY_SIDE], False)
        at = _worth_search(scores, weights["T"])
        held.append(scores[:, :, at])
        places += (lo + at).tolist()
        if places and (len(places) >= SEARCHED or lo + SIDE_BY_SIDE >= len(x)):
            for r, *span in _found(np.concatenate(held, axis=2), weights["T"]):
                yield places[r], *span
            held, places = [], []


def decoded_spans(texts: list[str], weights: dict) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, probability) of the spans that the network finds in each text, reconciled."""
    groups: dict[int, list[tuple[int, int]]] = {}
    codes = [symbols(t) for t in texts]
    for i, t in enumerate(texts):
        for start, width in _windows(len(t)):
            groups.setdefault(width, []).append((i, start))
    found: list[list[tuple]] = [[] for _ in texts]
    for width, places in groups.items():
        x = np.zeros((len(places), width), np.uint8)
        for r, (i, start) in enumerate(places):
            part = codes[i][start : start + width]
            x[r, : len(part)] = part
        for r, a, b, kind, value in _spans_of(weights, x):
            i, start = places[r]
            length = len(texts[i])
            if start + a < length:
                found[i].append((start + a, min(start + b + 1, length), KINDS[kind], value, start, a == 0 and start > 0, b == width - 1 and start + width < length))
    return [_reconciled(spans, len(t)) for spans, t in zip(found, texts, strict=True)]


def _reconciled(spans: list[tuple], length: int) -> list[tuple[str, int, int, float]]:
    """Spans (start, end, kind, log probability, window's start, cut at its start, cut at its end) as one list.

    A whole span counts in the window whose centre is nearest to its middle. Parts cut at an edge
    are joined with those of the next window that they overlap; parts that stay cut are dropped. Of
    overlapping spans the more probable stays.
    """
    step = WINDOW - OVERLAP
    last = _windows(length)[-1][0] if length else 0
    whole, parts = [], []
    for a, b, kind, value, start, left, right in sorted(spans):
        if left or right:
            if parts and parts[-1][6] and left and parts[-1][2] == kind and parts[-1][4] + step == start and a < parts[-1][1]:
                first = parts.pop()
                a, value, left = first[0], min(first[3], value), first[5]
            parts.append((a, b, kind, value, start, left, right))
        elif min(max(0, ((a + b) // 2 - OVERLAP // 2) // step * step), last) == start:
            whole.append((a, b, kind, value))
    whole += [s[:4] for s in parts if not s[5] and not s[6]]
    out: list[tuple] = []
    for a, b, kind, value in sorted(whole, key=lambda s: (-s[3], s)):
        if all(b <= x or y <= a for _, x, y, _ in out):
            out.append((kind, a, b, float(np.exp(value))))
    return sorted(out, key=lambda s: s[1])


def all_spans(texts: list[str], weights: dict, least: float = LEAST) -> list[tuple[list, list]]:
    """(pattern spans, spans the network adds) of each text."""
    out = []
    for text, more in zip(texts, decoded_spans(texts, weights), strict=True):
        mine, added = base_spans(text), []
        taken = sorted((a, b) for _, a, b in mine)
        for kind, a, b, sure in more:
            numbers = "".join(c for c in text[a:b] if c in "0123456789")
            fits = DIGITS[kind][0] <= len(numbers) <= DIGITS[kind][1] and (kind != "card" or luhn(numbers)) and (kind != "email" or "@" in text[a:b] or "at" in text[a:b].lower())
            cuts = (a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())
            if sure >= least and fits and not cuts:
                i = bisect_left(taken, (a, b))
                if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]) and all(y <= a or b <= x for x, y in taken[max(0, i - 4) : i + 4]):
                    added.append((kind, a, b))
        out.append((mine, added))
    return out


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def _chunks(texts: list[str], size: int = 1 << 21) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def find_personal_data(docs: DataFrame, seed: int = 7, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_spans) for every row.

    Counts and base_spans are of the fixed patterns; spans also holds what the network adds with a
    probability of at least `least`, and n_spans counts them all. Both
    are kind:start:end by kind and start, comma-joined, in code points with the end exclusive.
    Null and empty texts have none. Repeated and null ids stay; an empty table gives an empty
    result; other columns are ignored.
    """
    ready(docs.sparkSession)
    weights = train(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, full, every = [[] for _ in KINDS], [], [], []
            for part in _chunks(batch.column(1).to_pylist()):
                for mine, added in all_spans(part, weights, least):
                    kinds = [k for k, _, _ in mine]
                    for i, k in enumerate(KINDS):
                        counts[i].append(kinds.count(k))
                    base.append(_written(mine))
                    full.append(_written(mine + added))
                    every.append(len(mine) + len(added))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(full, pa.string()), pa.array(every, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "n_spans"],
            )

    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_spans long")


def redact(docs: DataFrame, seed: int = 7, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of docs, each span of personal data in the text replaced by its kind in brackets.

    Null and empty texts stay as they are. All other columns are kept; n_chars, if there is one,
    is counted anew.
    """
    ready(docs.sparkSession)
    weights = train(seed)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(at).to_pylist(), []
            for part in _chunks([t or "" for t in texts]):
                for text, (mine, added) in zip(part, all_spans(part, weights, least), strict=True):
                    out.append(_replaced(text, mine + added))
            new = [None if t is None else x for t, x in zip(texts, out, strict=True)]
            columns = [*batch.columns]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def _replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans are replaced as one, under the kind that starts first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    out.append(text[done:])
    return "".join(out)
