"""Texts for the tests of the text operators."""

WORDS = "one river runs below seven old stone bridges while nobody counts its many slow brown turns before winter comes again".split()


def sentence(k: int, n: int = 40) -> str:
    """Some words in an order that depends on k."""
    return " ".join(f"{WORDS[(i * (k + 3) + i * i) % len(WORDS)]}{(i * k) % 11 or ''}" for i in range(n))


def balanced(a: str, b: str, n: int = 2048) -> list[str]:
    """The Thue-Morse sequence of two signs; with them exchanged it has the same sums of many powers."""
    return [b if bin(i).count("1") % 2 else a for i in range(n)]
