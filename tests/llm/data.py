"""Small tables for the corpus operators, and what plain Python makes of them."""

import random
import re

LONG = " ".join(f"word{i % 700}x{i}" for i in range(30_000))


def corpus(seed: int = 3) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        rows.append((i, " ".join(words), "en" if i % 2 else None, f"s{i % 3}", len(words)))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(60, 90):
        words = list(base)
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, "  ".join(words).title(), "en", "s0", 0))
    for i in range(90, 110):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(40)) + "\n" + passage + "\t" + "end", "de", "s1", 0))
    rows += [
        (200, None, None, None, None), (201, "", "en", "s0", 0), (202, " \n\t ", "en", "s0", 0), (203, LONG, "en", "s0", 0), (204, "one two", "en", "s0", 0),
        (205, "one two", "en", "s0", 0), (206, "one two", "en", "s0", 0), (206, "one two", "en", "s0", 0), (207, "Éa ÉÁ ñ 日本語 ok's 12 — “q” œuvre", "fr", "s0", 0),
        (None, "no id " * 50, "en", "s0", 0),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
