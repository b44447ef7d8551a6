import random

from tarn.llm import secrets

KEY = "".join(random.Random(1).choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=86))


def found(text):
    base = secrets.base_spans(text)
    return [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.linked(base, secrets.weak_candidates(text, base))]


def test_long_secrets_and_identifiers_are_whole():
    name = "name." * 30
    assert found(f"AccountKey={KEY}== user={name}") == [("weak_secret", KEY), ("weak_id", f"user={name}")]
    assert found(f"github_pat_{KEY} at https://example.com") == [("weak_secret", f"github_pat_{KEY}"), ("weak_endpoint", "https://example.com")]


def test_parts_are_linked_by_the_gap_between_them():
    long = KEY * 5
    assert [k for k, _ in found(f"{long} user=somebody")] == ["weak_secret", "weak_id"]
    parts = lambda gap: [k for k, _ in found(f"{KEY}{' ' * gap}user=somebody")]
    assert parts(256) == ["weak_secret", "weak_id"] and parts(257) == []


def test_intervals_against_brute_force():
    r = random.Random(2)
    for _ in range(200):
        spans = sorted((a := r.randrange(4000), r.randrange(6), a + r.randrange(1, 900)) for _ in range(r.randrange(12)))
        parts, weak = [s for s in spans if s[1] < 3], [s for s in spans if s[1] > 2]
        near = lambda s, o: 0 <= max(o[0] - s[2], s[0] - o[2]) <= 256  # noqa: E731  what overlaps is no complement
        role = lambda s: secrets.ROLES[secrets.KINDS[s[1]]]
        assert secrets.linked(parts, weak) == [s for s in weak if any(role(o) in secrets.NEEDS[secrets.KINDS[s[1]]] and near(s, o) for o in spans)]
