"""Language models against plain Kneser-Ney with dictionaries; rejection on small and large tables; ties."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from leafgate.llm import langid
from tests.llm.conftest import rows

LANGS = {"en": "the of and to in that is was for on with as they at be this have from".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split()}


class Plain:
    """One language: counts of n-grams, discounted and interpolated, by recursion."""

    def __init__(self, words, floor):
        self.floor, grams = floor, Counter()
        for w, n in words.items():
            said = ["^"] * (langid.ORDER - 1) + list(w) + ["$"]
            for i in range(langid.ORDER - 1, len(said)):
                grams[tuple(said[i - langid.ORDER + 1 : i + 1])] += n
        self.counts = {langid.ORDER: grams}
        for n in range(langid.ORDER - 1, 0, -1):  # in how many longer ones
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.after = {n: defaultdict(dict) for n in self.counts}
        self.discount = {}
        for n, c in self.counts.items():
            for g, k in c.items():
                self.after[n][g[:-1]][g[-1]] = k
            ones, twos = sum(k == 1 for k in c.values()), sum(k == 2 for k in c.values())
            self.discount[n] = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))

    def p(self, history, c, n=langid.ORDER):
        if n == 0:
            return self.floor
        low = self.p(history, c, n - 1)
        after = self.after[n].get(tuple(history[len(history) - n + 1 :]))
        if not after:
            return low
        d, total = self.discount[n], sum(after.values())
        return max(after.get(c, 0) - d, 0) / total + min(d, min(self.counts[n].values())) * len(after) / total * low

    def bits(self, word):
        said = ["^"] * (langid.ORDER - 1) + list(word) + ["$"]
        return [-math.log2(max(self.p(said[:i], said[i]), 1e-12)) for i in range(langid.ORDER - 1, len(said))]


def test_models_equal_plain_kneser_ney():
    rng = random.Random(3)
    words = {lang: {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))): rng.randint(1, 5) for _ in range(60)} for lang in ("x", "y")}
    model = langid.Model(words)
    letters = {c for each in words.values() for w in each for c in w}
    plain = {lang: Plain(w, 1 / (len(letters) + 2)) for lang, w in words.items()}
    for _ in range(100):
        word = "".join(rng.choice("abcdéz") for _ in range(rng.randint(1, 8)))
        grams = langid.Grams(word + "\n")
        got = model.bits(grams, grams.at)
        for k, lang in enumerate(model.langs):
            assert np.allclose(got[:, k], plain[lang].bits(word), atol=1e-4), word


def corpus(n, rng):
    return [(10 * i + k, " ".join(rng.choice(words) for _ in range(60)), lang) for i in range(n) for k, (lang, words) in enumerate(LANGS.items())]


def test_predictions_equal_brute_force(make):
    rng = random.Random(8)
    learn = corpus(30, rng)
    model = langid.train(make(*learn))
    words = defaultdict(Counter)
    kept = {r["doc_id"] for r in make(*learn).where("pmod(xxhash64(doc_id, 1), 8) != 0").collect()}
    for i, text, lang in learn:
        if i in kept:
            words[lang].update(text.split())
    letters = {c for each in words.values() for w in each for c in w}
    plain = {lang: Plain(w, 1 / (len(letters) + 2)) for lang, w in words.items()}
    said = [" ".join(rng.choice(LANGS["en"] + LANGS["de"]) for _ in range(9)) for _ in range(60)]
    got = {r["doc_id"]: r for r in langid.identify(make(*enumerate(said)), model).collect()}
    for i, text in enumerate(said):
        h = {lang: sum(map(sum, map(m.bits, text.split()))) / (len(text.replace(" ", "")) + 9) for lang, m in plain.items()}
        best = min(sorted(h), key=h.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["bits_per_char"] - h[best]) < 1e-3


def test_noise_with_letters_is_rejected_on_small_and_large_tables(make):
    rng = random.Random(5)
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)) for _ in range(20)]
    clean = [t for _, t, _ in corpus(10, rng)]
    for n in (4, 40, 400):
        model = langid.train(make(*corpus(n, rng)))
        assert set(model.limits) == {"de", "en"} and all(math.isfinite(m) for m, _ in model.limits.values())
        got = langid.identify(make(*enumerate(clean + noise)), model)
        assert [r for _, r in rows(got, "doc_id", "rejected")] == [False] * len(clean) + [True] * len(noise)


def test_few_mislabelled_documents_leave_the_limit(make):
    rng = random.Random(6)
    docs = corpus(200, rng)
    wrong = [(5000 + i, "".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)), "en") for i in range(8)]
    plain, marred = langid.train(make(*docs)), langid.train(make(*docs, *wrong))
    assert abs(plain.limits["en"][0] - marred.limits["en"][0]) < 0.5


def test_a_tie_goes_to_the_language_that_sorts_first(make):
    same = [(i, "alpha beta gamma delta " * 9, lang) for i in range(40) for lang in ("zz", "aa")]
    model = langid.train(make(*[(10 * i + k, t, lang) for i, t, _ in same for k, lang in enumerate(("zz", "aa"))]))
    both = model.tables[0][0][1], model.tables[1][0][1]
    assert len(both[0]) == len(both[1])
    model.tables[1] = model.tables[0]
    assert {r["lang_pred"] for r in langid.identify(make((1, "alpha beta")), model).collect()} == {"aa"}
