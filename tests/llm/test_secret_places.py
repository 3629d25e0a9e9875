"""Entropy spans of planted credentials wherever they stand."""

import pytest

from docintake.llm import secret_scan

KEY = "Zk39qXv7Lm2Rt8Wb5Yc1Nd6P"


def entropy(text):
    return [text[s:e] for s, k, e in secret_scan.scan_text(text) if secret_scan.KINDS[k] == "entropy"]


@pytest.mark.parametrize(
    "text, want",
    [
        (f"postgres://admin:{KEY}@db/x", [KEY]),
        (f"postgres://admin:{KEY}@db.example.com/x", [KEY]),
        (f"https://{KEY}@github.com/a", [f"//{KEY}"]),
        (f"ftp://me:p!{KEY}@host.example.com", [KEY]),
        (f"name:{KEY}", [KEY]),
        (f"x.{KEY} @{KEY}", [KEY, KEY]),
        ("jwt eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4ifQ.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c", 3),
        ("b64 Kq9//Zt4Lx8Vb2Nm6Wp0Rs5+Kd7==", ["Kq9//Zt4Lx8Vb2Nm6Wp0Rs5+Kd7=="]),
        ("k=9F3A7C1E5B8D2064FA91", ["9F3A7C1E5B8D2064FA91"]),
        ("key qZtLxVbNmWpRsKdHgFcYjT", ["qZtLxVbNmWpRsKdHgFcYjT"]),
        (f"https://host.example.com/path?sig={KEY}", [KEY]),
    ],
)
def test_found(text, want):
    assert entropy(text) == want or len(entropy(text)) == want


@pytest.mark.parametrize(
    "text",
    [
        "https://host.example.com/a1b2c3d4e5f6g7h8i9j0k1", "mail first.last-q9Zt4Lx8Vb2Nm6Wp0Rs5Kd7@example.com now", "id=123e4567-e89b-42d3-a456-426614174000",
        "getElementsByTagNameAndParserXMLHttpRequest", "a_quick_brown_fox_jumps_over_lazy_dogs", "order 20240101-123456789012345678901-77",
        "internationalization uncharacteristically", "==========----------////////", "abcdefgh" * 5,
    ],
)
def test_harmless(text):
    assert entropy(text) == []


def test_long_runs_stay_linear():
    assert entropy("aB" * 100_000 + "@") == [] and entropy("ab-" * 100_000 + "!") == [] and len(entropy("abc" * 10_000 + "1 " + f"{KEY} " * 2_000)) == 2_000
