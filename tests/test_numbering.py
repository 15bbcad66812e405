"""Numbering by alignment against a plain dynamic program; moments far from zero."""

import random

import numpy as np
import pytest

from loopweave.functions import numbering
from loopweave.functions.annotate import annotate
from loopweave.operators import scale
from loopweave.schemas import ALPHABET


def plain(profile, s, opening, extending):
    """Gotoh's three tables, one cell at a time; match before skip before insertion."""
    none = -(10**9)
    P, L = len(profile.positions), len(s)
    t = [[[none] * 3 for _ in range(L + 1)] for _ in range(P + 1)]
    back = {}
    t[0][0][0] = 0
    for p in range(P + 1):
        for at in range(L + 1):
            for state, (dp, dl) in enumerate(((1, 1), (1, 0), (0, 1))):
                if p - dp < 0 or at - dl < 0:
                    continue
                gain = int(profile.weights[p - 1][ALPHABET.find(s[at - 1])]) if state == 0 else 0
                came = [t[p - dp][at - dl][k] + gain - (0 if state == 0 else extending if k == state else opening) for k in range(3)]
                k = max(range(3), key=lambda k: (came[k], -k))
                if came[k] > none // 2:
                    t[p][at][state], back[p, at, state] = came[k], k
    state = max(range(3), key=lambda k: (t[P][L][k], -k))
    score, p, at, out = t[P][L][state], P, L, [None] * L
    while p or at:
        if state != 1:
            out[at - 1] = int(profile.positions[p - 1]) if p else None
        p, at, state = p - (state != 2), at - (state != 1), back[p, at, state]
    return score, out


def random_profile(rng, positions):
    weights = np.array([[rng.randint(-20, 5) for _ in ALPHABET] + [0] for _ in range(positions)])
    best = [rng.randrange(20) for _ in range(positions)]
    weights[np.arange(positions), best] = 40
    return numbering.Profile("p", np.arange(1, positions + 1) * 2, weights), "".join(ALPHABET[k] for k in best)


@pytest.mark.parametrize("opening, extending", [(40, 5), (7, 7), (0, 0)])
def test_alignment_against_the_plain_program(opening, extending):
    rng = random.Random(opening)
    for positions in (1, 12, 30):
        profile, consensus = random_profile(rng, positions)
        sequences = []
        for _ in range(60):
            s = list(consensus)
            for _ in range(rng.randint(0, 4)):
                k, n = rng.randrange(len(s) + 1), rng.randint(1, 4)
                s[k : k + (n if rng.random() < 0.5 else 0)] = rng.choices(ALPHABET + "X", k=n if rng.random() < 0.5 else 0)
            sequences.append("".join(s))
        score, found = numbering.align(profile, sequences, opening, extending)
        for s, v, got in zip(sequences, score, found, strict=True):
            assert (v, got) == plain(profile, s, opening, extending), s


def test_insertions_and_gaps():
    rng = random.Random(1)
    profile, s = random_profile(rng, 20)
    aligner = numbering.Aligner([profile])
    assert aligner(s) == list(range(2, 42, 2)) and aligner("") == []
    assert aligner(s[:5] + s[8:]) == [*range(2, 12, 2), *range(18, 42, 2)]
    got = aligner(s[:10] + "XXX" + s[10:])
    assert got == [*range(2, 22, 2), 20, 20, 20, *range(22, 42, 2)]
    assert aligner("XX" + s)[:3] == [None, None, 2]
    other, t = random_profile(random.Random(2), 20)
    both = numbering.Aligner([profile, numbering.Profile("q", other.positions + 100, other.weights)], batch=2)
    assert [p[0] for p in both.many([s, t, s[:12], t[:15]])] == [2, 102, 2, 102]
    for wrong in (lambda: numbering.Aligner([]), lambda: numbering.Aligner([profile], 1, 2)):
        with pytest.raises(ValueError):
            wrong()


def test_residues_are_numbered_by_learnt_profiles(spark):
    """Profiles from numbered residues; files with numbers of their own are numbered again, what has no position keeps its number."""
    rng = random.Random(3)
    # a letter comes again after twenty places only, so a gap has one place
    kinds = {k: "".join(rng.sample(ALPHABET, 20)) * 2 for k in "hl"}
    trusted = spark.createDataFrame([(k, p + 20, c) for k, s in kinds.items() for _ in range(6) for p, c in enumerate(s)] + [("h", None, "A"), ("h", 21, "?")], "profile string, imgt_pos int, one_letter string")
    profiles = numbering.profiles_of(trusted)
    assert profiles.count() == 2 * 40 * 20
    aligner = numbering.Aligner.of(profiles)
    rows, want = [], {}
    for n in range(30):
        kind = "hl"[n % 2]
        keep = [p for p in range(40) if not n % 10 <= p - 5 < n % 10 * 2 - n % 7 and p]
        rows += [(f"s{n}", o, "A", 900 + o, kinds[kind][p]) for o, p in enumerate(keep)]
        want |= {(f"s{n}", o): p + 20 for o, p in enumerate(keep)}
    residues = spark.createDataFrame(rows, "structure_id string, ordinal int, chain_id string, res_seq int, one_letter string")
    got = annotate(residues, aligner).collect()
    assert {(r.structure_id, r.ordinal): r.imgt_pos for r in got} == want
    assert {r.region for r in got if 27 <= r.imgt_pos <= 38} == {"CDR-H1"}
    alone = annotate(residues.where("structure_id = 's0'"), lambda s: [None] * 3 + [50]).orderBy("ordinal").collect()
    assert [r.imgt_pos for r in alone[:5]] == [900, 901, 902, 50, 904]


def test_moments_far_from_zero(spark):
    x = np.random.default_rng(0).normal(size=(500, 2)) + 1e8
    df = spark.createDataFrame([([float(a), float(b)],) for a, b in x], "vector array<double>").repartition(7)
    n, mean, cov = scale.moments(df)
    assert n == 500 and np.allclose(mean, x.mean(0), rtol=1e-14) and np.allclose(cov, np.cov(x.T, bias=True), atol=1e-6)
    assert scale.moments(df.limit(0))[0] == 0 and scale.moments(df.limit(1))[2].tolist() == [[0, 0], [0, 0]]
