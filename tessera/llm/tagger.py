"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by exact gradients, decoding by Viterbi."""

from __future__ import annotations

import os
import random
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
WINDOW = 128
HIDDEN = 16
PAD = 0
_SIGNS = "@.-+() \n_%:/,;#*&=\"'[]"
DIGIT, LOWER, UPPER, OTHER = range(1 + len(_SIGNS), 5 + len(_SIGNS))
CLASSES = OTHER + 1
_TABLE = np.full(256, OTHER, np.int8)
for _i, _c in enumerate(_SIGNS):
    _TABLE[ord(_c)] = 1 + _i
_TABLE[ord("0") : ord("9") + 1] = DIGIT
_TABLE[ord("a") : ord("z") + 1] = LOWER
_TABLE[ord("A") : ord("Z") + 1] = UPPER
_TABLE[0xC0:] = LOWER


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point; those beyond Latin count as lower-case letters."""
    return _TABLE[np.minimum(codes, 255)]


class Tagger:
    """p: E (2, classes, 4H), W (2, H, 4H), O (2H, tags), b (tags), A (tags, tags). The gates are input, forget, output, candidate."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    def hidden(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x (B, T) -> (B, T, 2H); both directions run in one loop, the second over the reversed text."""
        e, w = self.p["E"], self.p["W"]
        (n, t), size = x.shape, w.shape[1]
        both = np.stack([x, x[:, ::-1]])
        h, c = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        out = np.empty((2, t, n, size), np.float32)
        side = np.arange(2)[:, None]
        for k in range(t):
            a = e[side, both[:, :, k]] + h @ w
            a[..., : 3 * size] *= 0.5
            np.tanh(a, out=a)
            gates, g = a[..., : 3 * size] * 0.5 + 0.5, a[..., 3 * size :]
            i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
            before = c
            c = f * c + i * g
            s = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, s))
            h = out[:, k] = o * s
        return np.concatenate([out[0].transpose(1, 0, 2), out[1, ::-1].transpose(1, 0, 2)], 2)

    def emissions(self, x: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        h = self.hidden(x, keep)
        return h @ self.p["O"] + self.p["b"], h

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (B, T), and how much better than `O` each position's tag is."""
        e, _ = self.emissions(x)
        e[x == PAD] -= 1e4
        e[x == PAD, 0] += 1e4
        a, best = self.p["A"], e[:, 0]
        back = np.empty(e.shape, np.int8)
        for k in range(1, e.shape[1]):
            both = best[:, :, None] + a
            back[:, k] = both.argmax(1)
            best = both.max(1) + e[:, k]
        tags = np.empty(x.shape, np.int8)
        rows = np.arange(len(x))
        tags[:, -1] = best.argmax(1)
        for k in range(x.shape[1] - 1, 0, -1):
            tags[:, k - 1] = back[rows, k, tags[:, k]]
        return tags, np.take_along_axis(e, tags[..., None].astype(int), 2)[..., 0] - e[..., 0]

    def ahead(self, tags: np.ndarray, start: int, end: int) -> float:
        """By how much the transitions into, through and out of tags[start:end] beat those of `O` in that place."""
        own, a = tags[max(0, start - 1) : end + 1].astype(int), self.p["A"]
        plain = own.copy()
        plain[start - max(0, start - 1) :][: end - start] = 0
        return float((a[own[:-1], own[1:]] - a[plain[:-1], plain[1:]]).sum())

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log likelihood of the tags y, and its gradients: CRF marginals, then back through time."""
        p, keep = self.p, []
        e, h = self.emissions(x, keep)
        (n, t), a = x.shape, p["A"]
        many = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        ahead, back = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0]
        for k in range(1, t):
            ahead[:, k] = many(ahead[:, k - 1, :, None] + a, 1) + e[:, k]
        for k in range(t - 2, -1, -1):
            back[:, k] = many(a + (e[:, k + 1] + back[:, k + 1])[:, None, :], 2)
        z = many(ahead[:, -1], 1)
        de = np.exp(ahead + back - z[:, None, None])
        pair = np.exp(ahead[:, :-1, :, None] + a + (e + back)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
        hot = np.eye(TAGS, dtype=np.float32)[y]
        loss = float((z - (e * hot).sum((1, 2)) - a[y[:, :-1], y[:, 1:]].sum(1)).mean())
        de = (de - hot) / n
        seen = np.zeros_like(a)
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        size = p["W"].shape[1]
        g = {"A": (pair - seen) / n, "O": np.einsum("ntf,ntk->fk", h, de), "b": de.sum((0, 1)), "E": np.zeros_like(p["E"]), "W": np.zeros_like(p["W"])}
        dh = de @ p["O"].T
        dh = np.stack([dh[..., :size], dh[:, ::-1, size:]])
        both = np.stack([x, x[:, ::-1]])
        later, dc = np.zeros((2, n, size), np.float32), np.zeros((2, n, size), np.float32)
        back_w = p["W"].transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            hp, cp, i, f, o, c, s = keep[k]
            d = dh[:, :, k] + later
            dc = dc + d * o * (1 - s * s)
            da = np.concatenate([dc * c * i * (1 - i), dc * cp * f * (1 - f), d * s * o * (1 - o), dc * i * (1 - c * c)], 2)
            g["W"] += hp.transpose(0, 2, 1) @ da
            for side in (0, 1):
                np.add.at(g["E"][side], both[side, :, k], da[side])
            later, dc = da @ back_w, dc * f
        return loss, g


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        out[start:end] = 2 + 2 * k
        out[start] = 1 + 2 * k
    return out


def train(samples: list[tuple[str, list[tuple[str, int, int]]]], steps: int, seed: int = 5, batch: int = 48, hidden: int = HIDDEN, rate: float = 0.02) -> Tagger:
    """Trains on labelled spans: a sample is a text of at most WINDOW characters and its spans (kind, start, end). Adam, falling rate."""
    rng = np.random.default_rng(seed)
    init = lambda *shape, by=0.25: (rng.standard_normal(shape) * by).astype(np.float32)
    p = {"E": init(2, CLASSES, 4 * hidden), "W": init(2, hidden, 4 * hidden), "O": init(2 * hidden, TAGS), "b": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32)}
    p["E"][..., hidden : 2 * hidden] += 0.5
    x, y = np.zeros((len(samples), WINDOW), np.int64), np.zeros((len(samples), WINDOW), np.int64)
    for r, (text, spans) in enumerate(samples):
        codes = np.array([ord(c) for c in text[:WINDOW]], np.int64)
        x[r, : len(codes)], y[r, : len(codes)] = classes(codes), tags_of(len(codes), spans)
    first, second, model = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, Tagger(p)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(samples), batch)
        _, g = model.gradients(x[rows], y[rows])
        for k, v in g.items():
            v = np.clip(v, -5, 5).astype(np.float32)
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] -= rate * (1 - 0.9 * step / steps) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return model


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


#: Words after which people give such data, in the languages of the training texts; the spans' kinds beside them.
CUES = {
    "phone": "call ring phone tel. tel: telephone mobile fax whatsapp dial text sms cell hotline appelez téléphone portable rufen anrufen telefon handy llame teléfono móvil me at us on unter au al number",
    "email": "mail e-mail email write contact to cc from reply address écrivez courriel schreiben an correo escriba mailto:",
    "ip": "ip host server from address client peer at gateway adresse serveur servidor dns node",
    "card": "card visa mastercard payment paid with carte karte tarjeta number no. account",
}


def labelled(n: int, seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up texts with made-up personal data, with and without the words that announce it, and look-alikes that are none: dates, times, amounts, keys,
    versions, order numbers, tables of numbers, half addresses."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("etaoinshrdlucmfwypvbgkéèüßñó") for _ in range(r.randint(2, 10)))
    name = lambda: r.choice((str, str, str.capitalize, str.upper))(word())

    def card() -> str:
        body = digits(r.choice((12, 14, 15, 15, 15, 18)))
        body += next(d for d in "0123456789" if luhn(body + d))
        mark = r.choice(("", " ", "-", ".", "/", "_"))
        return mark.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        a, b, c, land = digits(3), digits(3), digits(4), digits(2)
        mark = r.choice("-. ")
        return r.choice((
            f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}{mark}{b}{mark}{c}", f"1{mark}{a}{mark}{b}{mark}{c}", f"+{land} {a} {b} {c}", f"00{land}{mark}{digits(2)}{mark}{digits(7)}",
            f"00{land}{mark}{a}{mark}{b}{mark}{c}", f"0{digits(2)}{mark}{digits(4)}{mark}{digits(4)}", f"0{digits(1)}{mark}" + mark.join(digits(2) for _ in range(4)), f"00{land}{mark}{digits(1)}{mark}" + mark.join(digits(2) for _ in range(4)),
        ))

    def email() -> str:
        own = name() + r.choice(("", "", f"{r.choice('._-+')}{name()}", f"{r.choice('._-+')}{digits(2)}", digits(2)))
        return f"{own}@{word()}{r.choice(('', '', f'.{word()}', f'-{word()}', digits(1)))}.{r.choice(('com', 'org', 'net', 'de', 'co.uk', 'example'))}"

    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    near = (
        lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", lambda: f"{digits(2)}.{digits(2)}.{r.randint(1900, 2030)}",
        lambda: f"{digits(2)}.{digits(2)} EUR", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 32, 40)))), lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: digits(r.randint(1, 12)), lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"AKIA{digits(8)}", lambda: f"@{word()}", lambda: f"{word()} @ {word()}", lambda: " ".join(digits(r.randint(1, 3)) for _ in range(6)),
        lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: f"key_{digits(10)}", lambda: "-".join(digits(r.randint(1, 2)) for _ in range(8)), lambda: f"{digits(5)}-{digits(4)}", lambda: f"# {digits(8)}",
        lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}", lambda: f"{r.choice(('order', 'invoice', 'item', 'ref'))} {digits(4)}-{digits(4)}-{digits(3)}", lambda: " ".join(digits(4) for _ in range(r.randint(2, 5))),
        lambda: f"{digits(3)}.{digits(3)}.{digits(3)} {word()}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", lambda: f"{digits(2)}-{digits(2)}-{digits(2)}",
    )
    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans, length = "", [], r.randint(60, WINDOW)
        text = "" if r.random() < 0.2 else word()[r.randint(0, 3) :] + " "
        while len(text) < length:
            u = r.random()
            if u < 0.24:
                kind = r.choice(("email", "ip", "card", "phone", "phone"))
                part, cue = makers[kind](), ""
                if r.random() < 0.6:
                    cues = CUES[kind].split()
                    cue = r.choice((str, str, str.capitalize))(" ".join(r.choice(cues) for _ in range(r.randint(1, 2)))) + r.choice((" ", " ", ": "))
                if len(text) + len(cue) + len(part) <= WINDOW:
                    text += cue
                    spans.append((kind, len(text), len(text) + len(part)))
                    text += part
            elif u < 0.42:
                text += r.choice(near)()
            else:
                text += " ".join(name() for _ in range(r.randint(1, 4)))
            text += r.choice((" ", " ", " ", ", ", ". ", "\n", ": ", "; ", "*** ", ") "))
        out.append((text[:WINDOW], [s for s in spans if s[2] <= WINDOW]))
    return out


#: The trained weights: what train(labelled(SAMPLES), STEPS) gives, as `python -m tessera.llm.tagger` writes them.
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "tagger.npz")
SAMPLES, STEPS = 6000, 1400


@lru_cache(maxsize=1)
def default() -> Tagger:
    """The tagger with the weights beside this file."""
    with np.load(WEIGHTS) as held:
        return Tagger({k: held[k] for k in held.files})


if __name__ == "__main__":
    np.savez(WEIGHTS, **train(labelled(SAMPLES), STEPS).p)
