"""Op 2: personal data by patterns and a character-level bidirectional LSTM with a CRF.

The base spans are the stated patterns, found in time linear in the text. The model is
trained in numpy, once a process, from labelled spans: by default generated ones, set among
invented words and look-alikes (dates, prices, versions, keys); ``train`` takes any others.
Every text is read in full by overlapping windows, whose scores are averaged where they overlap. One
Viterbi path over the whole text reconciles them, so no span is cut or doubled at a window's edge: where
no stay in other tags can gain on "outside", by bounds on scores and transitions, the best path
is outside, so only the runs between such characters are decoded, and of them those that hold what a
span needs to pass its kind's check. Texts above ``STRETCH``
characters are decoded in stretches that overlap; a span belongs to the stretch it starts in. Model
spans are added where they pass the kind's check and touch no base span.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read, sole

# Fixed values of the base patterns.
KINDS = ("email", "ip", "card", "phone")
# The same matches in linear time: an address is sought from each @ back; no number is
# entered in its middle; nothing that was taken is given back where that can't help.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW, STRIDE, HIDDEN = 256, 224, 16
#: Characters of a training example.
EXAMPLE = 128
#: Characters of a long text that are decoded at a time; rows of windows that the network reads at a time.
STRETCH, ROWS = 292 * STRIDE, 512
#: Characters, with padding, whose paths are sought side by side.
CELLS = 1 << 18
#: Characters of doubtful runs that are kept until their paths are sought.
RUNS = 1 << 20
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
CHARS = 128
Span = tuple[str, int, int]
_MODEL: dict[tuple[int, int], Tagger] = {}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        out += emails(text)
    if not re.search("[0-9]", text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def passes(kind: str, text: str) -> bool:
    """Whether a model span can be of its kind at all."""
    d = re.sub(r"\D", "", text)
    if kind == "email":
        return bool(re.search(r"[@\uff20]|[\[({<]at[\])}>]| at .* dot ", text)) and bool(re.search(r"[A-Za-z]\S*$", text))
    if kind == "ip":
        parts = re.findall(r"\d+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(d) <= 19 and all(ord(c) < 128 for c in d) and luhn(d)
    return 9 <= len(d) <= 15 and bool(re.search(r"[\s().-]", text))


# labelled spans


def generated(n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Texts of about ``EXAMPLE`` characters with labelled spans."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkjqxzéèàçñóäöüß"
    word = lambda: "".join(r.choices(letters, range(len(letters), 0, -1), k=r.randint(2, 9)))
    num = lambda k: "".join(r.choices("0123456789", k=k))
    plain = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8)))

    def card() -> str:
        d = r.choice("3456") + num(r.choice((14, 14, 14, 13)))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", " ", "-", ".", "/"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def email() -> str:
        who = r.choice((plain(), f"{plain()}.{plain()}", f"{plain()}.{num(2)}", f"{plain()}_{plain()}"))
        host = r.choice((f"{plain()}.{r.choice(('com', 'org', 'net', 'de'))}", f"mail{num(1)}.{plain()}.com"))
        form = r.choice(("{}@{}", "{}@{}", "{}@{}", "{} @ {}", "{}[at]{}", "{} (at) {}", "{}{{at}}{}", "{}\uff20{}", "{} at {}"))
        out = form.format(who, host)
        return out.replace(".", " dot ") if " at " in out else out

    def phone() -> str:
        return r.choice((f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"+{num(2)}.{num(3)}.{num(3)}.{num(3)}"))

    def ip() -> str:
        p = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice((".", ".", ".", "[.]", " . ")).join(p)

    def other() -> str:
        return r.choice((
            f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}", f"{num(1)}.{num(1)}", f"version {num(1)}.{num(1)}.{num(1)}.", f"${num(1)},{num(3)}.{num(2)}", f"1{num(1)}:{num(2)}", "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)),
            f"{plain()} at {plain()}", f"at {plain()} {plain()}", f"{plain()} dot {plain()}", "ghp_" + "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=30)), f"v{num(1)}.{num(2)}", f"id={num(8)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(3)}x{num(3)}", f"0x{num(8)}",
            "password=" + "".join(r.choices("0123456789abcdef", k=18)), 'token = "' + "".join(r.choices("0123456789abcdef", k=40)) + '"', f"#{num(6)}", f"{num(4)}", f"CC BY-NC {num(1)}.{num(1)}", f"@{plain()}", f"{num(5)} {num(5)} {num(2)}", "http://" + plain() + ".com/" + num(5), num(r.randint(1, 20)),
        ))

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < EXAMPLE - 30:
            kind = r.choices((None, "other", *KINDS), (8, 2, 1, 1, 1, 1))[0]
            piece = word() if kind is None else other() if kind == "other" else {"email": email, "ip": ip, "card": card, "phone": phone}[kind]()
            if kind in KINDS:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + r.choice((" ", " ", " ", ". ", ", ", "\n", " | "))
        out.append((text, spans))
    return out


# the model


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is; other letters, digits, the wide @ and the rest as one each."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint8, copy=True) if text.isascii() else None
    if a is not None:
        a[a >= 127] = 3
        return a
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    big = a >= 127
    met, back = np.unique(a[big], return_inverse=True)
    out = a.astype(np.uint8)
    out[big] = np.array([4 if c == 0xFF20 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in met.tolist()], np.uint8)[back]
    return out


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), which stands for tanh; a gate is half of it above one half. Its slope is (1 - |squash(x)|) ** 2."""
    return x / (1 + np.abs(x))


def slope(q: np.ndarray) -> np.ndarray:
    return (1 - np.abs(q)) ** 2


class Tagger:
    def __init__(self, seed: int = 5, hidden: int = HIDDEN):
        g = np.random.default_rng(seed)
        f = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h = hidden
        self.p = {"out": f(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p[f"x{d}"] = 0.3 * g.standard_normal((CHARS, 4 * hidden)).astype(np.float32)
            self.p[f"h{d}"] = f(hidden, 4 * hidden)
            self.p[f"c{d}"] = np.repeat(np.array([0, 3, 0, 0], np.float32), hidden)

    def lstm(self, ids: np.ndarray, d: str, keep: list) -> np.ndarray:
        """Hidden states [time, row, hidden] in reading order of direction ``d``; ids [time, row]."""
        n, h = self.h, np.zeros((ids.shape[1], self.h), self.p["out"].dtype)
        c, out = h.copy(), np.empty((*ids.shape, self.h), h.dtype)
        x, wh, b = self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"c{d}"]
        for t in range(len(ids)):
            z = x[ids[t]] + h @ wh + b
            q = squash(z)
            s, g = 0.5 + 0.5 * q[:, : 3 * n], q[:, 3 * n :]
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            before, last = c, h
            c = f * c + i * g
            e = squash(c)
            h = o * e
            out[t] = h
            keep.append((i, f, o, g, before, last, e))
        return out

    def states(self, ids: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        f, b = keep or ([], [])
        return np.concatenate([self.lstm(ids, "f", f), self.lstm(ids[::-1], "b", b)[::-1]], 2)

    def unary(self, ids: np.ndarray) -> np.ndarray:
        """Scores [time, row, tag], where a tag's lie together in memory: ``states`` and the output without what training needs, in place.

        Both directions go a step at a time, and a gate's units lie together [gate, direction, row, unit], so
        no step works on slices of rows. States are held doubled, and what reads them is halved, which changes
        no bit of a product."""
        n, (steps, rows) = self.h, ids.shape
        ids = ids.astype(np.intp)
        ids = np.concatenate([ids, ids[::-1] + CHARS], 1)
        apart = lambda w: w.reshape(-1, 4, n).transpose(1, 0, 2)
        x = np.concatenate([apart(self.p[f"x{d}"] + self.p[f"c{d}"]) for d in "fb"], 1)
        wh = np.stack([apart(self.p[f"h{d}"]) for d in "fb"], 1) * np.float32(0.5)
        states = np.empty((2, steps, rows, n), np.float32)
        h, c, e = (np.zeros((2, rows, n), np.float32) for _ in range(3))
        z, a = (np.empty((4, 2, rows, n), np.float32) for _ in range(2))
        looked, gates, (i, f, o, g) = a.reshape(4, 2 * rows, n), z[:3], z
        for t in range(steps):
            x.take(ids[t], 1, out=looked, mode="clip")
            np.matmul(h, wh, out=z)
            z += a
            np.abs(z, out=a)
            a += 1
            z /= a
            gates += 1  # times two: halves are taken once, below
            c *= f
            np.multiply(i, g, out=e)
            c += e
            c *= 0.5
            np.abs(c, out=e)
            e += 1
            np.divide(c, e, out=e)
            h = np.multiply(e, o, out=states[:, t])
        out = self.p["out"].T * np.float32(0.5)
        u, back = (np.matmul(w, s.reshape(-1, n).T).reshape(TAGS, steps, rows) for w, s in zip((out[:, :n], out[:, n:]), states))
        u += back[:, ::-1]
        u += self.p["bias"][:, None, None]
        return u.transpose(1, 2, 0)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag paths and its gradients; ids, tags [time, row]."""
        keep: tuple[list, list] = ([], [])
        s = self.states(ids, keep)
        u, tr = s @ self.p["out"] + self.p["bias"], self.p["trans"]
        steps, rows = ids.shape
        r = np.arange(rows)
        alpha, beta = np.empty_like(u), np.zeros_like(u)
        alpha[0] = u[0]
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        for t in range(1, steps):
            alpha[t] = u[t] + lse(alpha[t - 1][:, :, None] + tr, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(tr + (u[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        gold = sum(u[t, r, tags[t]] for t in range(steps)) + sum(tr[tags[t - 1], tags[t]] for t in range(1, steps))
        du = np.exp(alpha + beta - z[:, None])
        dtr = np.zeros_like(tr)
        for t in range(1, steps):
            dtr += np.exp(alpha[t - 1][:, :, None] + tr + (u[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(dtr, (tags[t - 1], tags[t]), -1)
        for t in range(steps):
            du[t, r, tags[t]] -= 1
        du, dtr = du / rows, dtr / rows
        g = {"trans": dtr, "out": np.tensordot(s, du, ((0, 1), (0, 1))), "bias": du.sum((0, 1))}
        ds = du @ self.p["out"].T
        n = self.h
        for d, part, k, order in (("f", ds[:, :, :n], keep[0], ids), ("b", ds[::-1, :, n:], keep[1], ids[::-1])):
            dh, dc = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
            gx, every = np.zeros_like(self.p[f"x{d}"]), np.zeros((steps, rows, 4 * n), self.p["out"].dtype)
            for t in range(steps - 1, -1, -1):
                i, f, o, a, before, last, e = k[t]
                dh = dh + part[t]
                dc = dc + dh * o * slope(e)
                gate = lambda x: 0.5 * slope(2 * x - 1)
                dz = np.concatenate([dc * a * gate(i), dc * before * gate(f), dh * e * gate(o), dc * i * slope(a)], 1)
                every[t] = dz
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            flat, met = every.reshape(-1, 4 * n), order.ravel()
            by = np.argsort(met, kind="stable")
            chars, first = np.unique(met[by], return_index=True)
            gx[chars] = np.add.reduceat(flat[by], first)
            lasts = np.concatenate([x[5] for x in k])
            g |= {f"x{d}": gx, f"h{d}": lasts.T @ flat, f"c{d}": flat.sum(0)}
        return float((z - gold).mean()), g

    def viterbi(self, unary: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag path of each [time, TAGS]; all in step, longest first."""
        by = sorted(range(len(unary)), key=lambda i: -len(unary[i]))
        n = np.array([len(unary[i]) for i in by])
        most = int(n[0]) if len(n) else 0
        best = np.zeros((most, TAGS, len(by)), np.float32)
        for k, i in enumerate(by):
            best[: n[k], :, k] = unary[i]
        active = np.searchsorted(-n, -np.arange(most), "left")
        tr = self.p["trans"]
        for t in range(1, most):
            m = active[t]
            best[t, :, :m] += (best[t - 1, :, None, :m] + tr[:, :, None]).max(0)
        # back from each end, all in step: only the chosen tag's predecessors are compared
        path, tag = np.zeros((most, len(by)), np.int8), np.zeros(len(by), np.int64)
        for t in range(most - 1, -1, -1):
            m, on = active[t], active[t + 1] if t + 1 < most else 0
            score = best[t, :, :m].copy()
            score[:, :on] += tr[:, tag[:on]]
            tag[:m] = score.argmax(0)
            path[t, :m] = tag[:m]
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(by)
        for k, i in enumerate(by):
            out[i] = path[: n[k], k]
        return out


def tags_of(text: str, spans: list[Span]) -> np.ndarray:
    out = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        out[a:b] = 2 + 2 * KINDS.index(kind)
        out[a] -= 1
    return out


def train(labelled: list[tuple[str, list[Span]]], epochs: int = 3, rows: int = 32, seed: int = 5, rate: float = 0.03) -> Tagger:
    """Fit by Adam on labelled texts, all cut or padded to ``EXAMPLE`` characters."""
    model, g = Tagger(seed), np.random.default_rng(seed)
    ids, tags = (np.zeros((len(labelled), EXAMPLE), np.int64) for _ in range(2))
    for i, (text, spans) in enumerate(labelled):
        k = min(EXAMPLE, len(text))
        ids[i, :k], tags[i, :k] = codes(text)[:k], tags_of(text, spans)[:k]
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(v) for k, v in model.p.items()}
    step, total = 0, epochs * (len(labelled) // rows)
    for _ in range(epochs):
        order = g.permutation(len(labelled))
        for at in range(0, len(order) - rows + 1, rows):
            some = order[at : at + rows]
            _, grad = model.gradients(ids[some].T, tags[some].T)
            norm = np.sqrt(sum(float((x * x).sum()) for x in grad.values()))
            step += 1
            lr = rate * (1 - step / (total + 1)) ** 0.5
            for k, x in grad.items():
                x = x * min(1, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                model.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def default_model(examples: int = 3000, epochs: int = 5) -> Tagger:
    """Trained from generated spans; the same in every process, and made once in each."""
    if (examples, epochs) not in _MODEL:
        _MODEL[examples, epochs] = train(generated(examples), epochs)
    return _MODEL[examples, epochs]


def unaries(model: Tagger, stretches: list[np.ndarray]) -> list[np.ndarray]:
    """Scores [tag, character] of each run of character classes: windows from its start on, averaged where they overlap."""
    windows, first = [], [0]
    for a in stretches:
        n = max(1, -(-(len(a) - WINDOW) // STRIDE) + 1)
        padded = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
        padded[: len(a)] = a
        windows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])
        first.append(first[-1] + n)
    every = np.concatenate(windows) if windows else np.zeros((0, WINDOW), np.uint8)
    u = np.empty((TAGS, *every.shape), np.float32)
    parts = -(-len(every) // ROWS)
    for i in range(parts):  # of like size
        at, end = len(every) * i // parts, len(every) * (i + 1) // parts
        u[:, at:end] = model.unary(np.ascontiguousarray(every[at:end].T)).T
    both, later = WINDOW - STRIDE, np.ones(len(every), bool)
    later[first[:-1]] = False
    later = np.flatnonzero(later)
    u[:, later, :both] = (u[:, later, :both] + u[:, later - 1, STRIDE:]) * np.float32(0.5)
    whole = lambda lo, hi: np.concatenate([u[:, lo:hi, :STRIDE].reshape(TAGS, -1), u[:, hi - 1, STRIDE:]], 1)
    return [whole(lo, hi)[:, : len(a)].T for a, lo, hi in zip(stretches, first, first[1:])]


def hopeful(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each run of character classes can hold a span that ``passes``: four digits, an @ or an "at"."""
    at = (a == ord("@")) | (a == 4)
    at[1:] |= (a[1:] == ord("t")) & (a[:-1] == ord("a"))
    worth = np.cumsum(np.concatenate([[0], ((a - ord("0") < 10) | (a == 2)) + 4 * at]))
    return worth[end] - worth[start] >= 4


def doubtful(model: Tagger, sums: list[np.ndarray], classes: list[np.ndarray] | None = None) -> list[tuple[int, int, np.ndarray]]:
    """(whose, start, scores) of the runs in each whole run of scores where the best path may leave "outside";
    with the character classes, of those that can hold a span that ``passes``."""
    tr = model.p["trans"].astype(float)
    # what a stay away from "outside" can gain at most by transitions: at a step inside it, and at both ends
    step = float((tr[1:, 1:] - tr[0, 0]).max())
    ends = (tr[0, 1:] - tr[0, 0]).max() + (tr[1:, 0] - tr[0, 0]).max() - step + 1e-3
    out = []
    for k, u in enumerate(sums):
        top = u[:, 1].copy()
        for j in range(2, TAGS):
            np.maximum(top, u[:, j], out=top)
        gain = np.cumsum(top - u[:, 0] + step, dtype=float)
        before = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]])) if len(u) else gain
        doubt = np.maximum.accumulate(gain[::-1])[::-1] - before + ends >= 0  # of all stays that hold a character, the best
        edge = np.flatnonzero(np.diff(np.concatenate([[False], doubt, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if classes is not None:
            some = hopeful(classes[k], start, end)
            start, end = start[some], end[some]
        for a, b in zip(start.tolist(), end.tolist()):
            lo, hi = max(0, a - 1), min(len(u), b + 1)
            part = u[lo:hi].copy()
            if lo < a:
                part[0, 1:] = -1e9
            if hi > b:
                part[-1, 1:] = -1e9
            out.append((k, lo, part))
    return out


def settled(model: Tagger, runs: list[tuple[int, int, np.ndarray]], n: int) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of the best paths' spans in the doubtful runs of ``n`` whole ones."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    by = sorted(runs, key=lambda r: -len(r[2]))  # those of like length together
    at = 0
    while at < len(by):
        # as many as fit some megabytes when all are as long as the first
        some = by[at : at + max(1, CELLS // max(1, len(by[at][2])))]
        at += len(some)
        for (k, lo, _), path in zip(some, model.viterbi([part for _, _, part in some])):
            if not path.any():
                continue
            for t in np.flatnonzero(path % 2 == 1).tolist():
                end = t + 1
                while end < len(path) and path[end] == path[t] + 1:
                    end += 1
                out[k].append(((int(path[t]) - 1) // 2, lo + t, lo + end))
    return [sorted(x, key=lambda s: s[1]) for x in out]


def decoded(model: Tagger, sums: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of the best path's spans in each whole run of scores."""
    return settled(model, doubtful(model, sums), len(sums))


def model_spans(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """What the model finds in each whole text, as code point spans; runs that can hold none that ``passes`` are left out."""
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, int, int, int]] = []
    unread: list[np.ndarray] = []  # character classes of the last of those held
    runs: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        """Scores of what is unread; only its doubtful runs are kept."""
        at = len(held) - len(unread)
        runs.extend((at + k, lo, part) for k, lo, part in doubtful(model, unaries(model, unread), unread))
        unread.clear()
        if sum(len(part) for _, _, part in runs) >= RUNS:
            settle()

    def settle() -> None:
        for (i, lo, start, end), found in zip(held, settled(model, runs, len(held))):
            text = texts[i]
            for kind, a, b in found:
                a, b = a + lo, b + lo
                if not start <= a < end:
                    continue
                body = text[a:b]
                a, b = a + len(body) - len(body.lstrip()), b - len(body) + len(body.rstrip())
                if a < b:
                    out[i].append((KINDS[kind], a, b))
        held.clear()
        runs.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        a = codes(text)
        for start in range(0, len(a), STRETCH):
            lo, hi = max(0, start - 2 * STRIDE), min(len(a), start + STRETCH + 4 * STRIDE)
            held.append((i, lo, start, start + STRETCH))
            unread.append(a[lo:hi])
            size += hi - lo
            if size >= 4 * STRETCH:
                flush()
                size = 0
    flush()
    settle()
    return out


def all_spans(model: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base, base and model) spans of each text."""
    out = []
    for text, found in zip(texts, model_spans(model, texts)):
        base = base_spans(text)
        more = [s for s in found if passes(s[0], text[s[1] : s[2]])]
        if more and base:  # both in order: a pointer tells what a span touches
            taken, free = np.array([b for _, b, _ in base]), []
            ends = np.maximum.accumulate([e for _, _, e in base])
            for s in more:
                k = int(np.searchsorted(taken, s[2]))  # base spans that begin before its end
                if not k or ends[k - 1] <= s[1]:
                    free.append(s)
            more = free
        out.append((base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: Tagger | None = None) -> DataFrame:
    """``keep`` columns, counts of base spans by kind, base_sha256, spans (base and model's),
    n_added and redacted (the text without any of them).

    Null texts count as empty, their redacted text stays null. Every row gives one row.
    """
    from pyspark.sql import types as T

    longs = [f"n_{k}" for k in KINDS]
    schema = T.StructType([*[docs.schema[k] for k in keep], *[T.StructField(k, T.LongType()) for k in longs], *[T.StructField(k, T.StringType()) for k in ("base_sha256", "spans")], T.StructField("n_added", T.LongType()), T.StructField("redacted", T.StringType())])
    sent = docs.sparkSession.sparkContext.broadcast((model or default_model()).p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("pii", _MODEL.clear)
        tagger = Tagger()
        tagger.p = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column(len(keep)).to_pylist()
                found = all_spans(tagger, [t or "" for t in texts])
                cols = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
                cols += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]), pa.array([joined(a) for _, a in found], pa.string()), pa.array([len(a) - len(b) for b, a in found], pa.int64())]
                cols.append(pa.array([t if t is None or not a else redacted(t, a) for t, (_, a) in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def op2_pii_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents")).drop("redacted")
