"""Labelled examples of personal data: spans of four kinds set into plain text.

The plain text comes from the corpus where there is some, else from the words below. Spans
stand alone, side by side, or next to things that look alike and are none.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
WORDS = "the call mail and address of our office was sent on to a card number for her account in server log with une der la est".split()
BETWEEN = (" ", " ", " ", " ", ", ", "; ", "\n", " / ", " and ", ": ")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng: np.random.Generator, words: list[str]) -> str:
    plain = "".join(c for c in words[rng.integers(len(words))] if c.isascii() and c.isalnum())
    return plain or "mail"


def email(rng: np.random.Generator, words: list[str]) -> str:
    name = _word(rng, words) + str(rng.choice(["", ".", "_", "-", "+"])) + (_digits(rng, 2) if rng.random() < 0.5 else _word(rng, words))
    host = [_word(rng, words).lower() + (_digits(rng, 1) if rng.random() < 0.5 else ""), *(["example"] if rng.random() < 0.5 else []), str(rng.choice(["com", "org", "net", "de", "fr", "es"]))]
    if rng.random() < 0.6:
        return f"{name}@{'.'.join(host)}"
    at = str(rng.choice([" (at) ", "(at)", " [at] ", "[at]"]))
    return name + at + str(rng.choice([".", at.replace("at", "dot")])).join(host)


def ip(rng: np.random.Generator, words: list[str]) -> str:
    return ".".join(map(str, rng.integers(0, 256, 4)))


def card(rng: np.random.Generator, words: list[str]) -> str:
    size = int(rng.choice([13, 15, 16, 16, 16, 16, 16, 19]))
    start = str(rng.integers(3, 7)) + _digits(rng, size - 2)
    whole = next(start + str(d) for d in range(10) if luhn(start + str(d)))
    mark = str(rng.choice(["", "", " ", "-"]))
    return mark.join(whole[k : k + 4] for k in range(0, size, 4)) if mark else whole


def phone(rng: np.random.Generator, words: list[str]) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    code = "+" + str(rng.integers(1, 99))
    shapes = [f"{code} ({a}) {b}-{c}", f"{code} ({a}) {b}-{c}", f"{code} {a} {b} {c}", f"{code}-{a}-{b}-{c}", f"{code}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]
    return shapes[rng.integers(len(shapes))]


def other(rng: np.random.Generator, words: list[str]) -> str:
    """What is none of these: secrets, versions, dates, plain numbers, handles."""
    hexed = "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, int(rng.choice([16, 32, 40]))))
    key = "".join("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[k] for k in rng.integers(0, 36, 16))
    shapes = [
        f'token = "{hexed}"', f"key={hexed}", f"AKIA{key}", f"CC BY-NC {rng.integers(1, 9)}.{rng.integers(0, 9)}.", f"v{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}",
        f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(0, 24)}:{rng.integers(0, 60):02d}", f"{rng.integers(0, 999)},{rng.integers(0, 99):02d}",
        _digits(rng, int(rng.integers(1, 13))), _digits(rng, int(rng.integers(20, 40))), "@" + _word(rng, words), f"{_digits(rng, 3)}-{_digits(rng, 4)}", f"{_word(rng, words)}{rng.integers(0, 99)}",
        f"({rng.integers(0, 999)})", f"+{rng.integers(0, 99)}", f"{rng.integers(0, 99)}.{rng.integers(0, 999)}.{rng.integers(0, 99)}",
    ]
    return shapes[rng.integers(len(shapes))]


MAKE = {"email": email, "ip": ip, "card": card, "phone": phone}


def example(rng: np.random.Generator, plain: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """A text and its spans (kind, start, end)."""
    around = plain[rng.integers(len(plain))] if plain else " ".join(rng.choice(WORDS, 14))
    words = [w for w in around.split() if w] or WORDS
    cut = int(rng.integers(0, len(around) + 1))
    text, spans = around[:cut][-40:], []
    if text and not text[-1].isspace() and rng.random() < 0.85:
        text += str(rng.choice([" ", " ", " ", "\n", ": ", " ("]))
    for k in range(int(rng.choice([1, 1, 2, 2, 3]))):
        if k:
            text += str(rng.choice(BETWEEN))
        if rng.random() < 0.3:
            text += other(rng, words)
            continue
        kind = KINDS[rng.integers(len(KINDS))]
        if text and text[-1].isalnum() and kind != "phone":
            text += " "
        made = MAKE[kind](rng, words)
        spans.append((kind, len(text), len(text) + len(made)))
        text += made
    return text + str(rng.choice([" ", " ", ". ", ",", "\n", ") "])) + around[cut:][:40], spans
