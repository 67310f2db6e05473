import random
import re

from gradeline.llm import licenses


def brute(text):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        for k in range(len(words) - len(parts) + 1):
            if words[k : k + len(parts)] == parts:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force_and_stays(make):
    rng = random.Random(3)
    parts = ["under", "The", "MIT", "license", "LICENSE,", "apache", "version", "2", "2.0", "cc", "BY", "nc", "é", "unlicense", "\n", "-", "x_y", "İ", "license2"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += ["Under the MIT-License. " * 700, "apache license, version 2" * 3, "cc-by-nc 4.0", "ünder the mit license", "under the mit licenseé", None, "", "wörd " * 30000 + "cc by nc"]
    rows = list(enumerate(texts)) + [(None, "cc by nc"), (0, texts[0]), (0, texts[1])]
    got = licenses.license_labels(make(rows)).collect()
    assert len(got) == len(rows)
    want = sorted((i is not None, i or 0, *[(-1 if v is None else v) for v in brute(t)[:4]], brute(t)[4]) for i, t in rows)
    told = sorted((r.id is not None, r.id or 0, r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels) for r in got)
    assert told == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
        assert (r.score > 0) == bool(r.labels)


def test_rules_and_suppression(make):
    texts = [
        "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GNU General Public License, version 3",
        "Licensed under the Apache License, Version 2.0.", "Released under CC BY-SA 4.0", "All rights reserved.",
        "the public license of nothing", "Released under the BSD-3 license and licensed under the zlib license",
    ]
    got = {r.id: (r.labels, r.score) for r in licenses.license_labels(make(enumerate(texts))).collect()}
    assert got == {
        0: ("gpl-3", 1.0), 1: ("gpl-3", 1.0), 2: ("apache-2", 1.0), 3: ("cc-by-sa", 1.0),
        4: ("all-rights-reserved", 0.7), 5: ("", 0.0), 6: ("bsd-3,zlib", 1.0),
    }
    assert len(licenses.rules()) > 200


def test_no_python_and_empty_table(make):
    df = licenses.license_labels(make([(1, "x")]))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert licenses.license_labels(make([])).count() == 0


def test_each_rule_fires_on_a_minimal_text(make):
    texts = {
        "Released under the BSD": "bsd", "distributed under Apache 2.0": "apache-2", "released under MIT": "mit",
        "proprietary and confidential": "proprietary", "Expat license": "mit", "PSF license": "psf",
        "Python  Software\nFoundation License": "psf",
    }
    identifiers = {
        "EPL-2.0": "epl", "EDL-1.0": "edl", "CPL-1.0": "cpl", "IPL-1.0": "ibm", "BSL-1.0": "boost", "BUSL-1.1": "business",
        "SSPL-1.0": "sspl", "OFL-1.1": "ofl", "ODbL-1.0": "odbl", "ODC-By-1.0": "odc-by", "PDDL-1.0": "pddl",
        "PSF-2.0": "psf", "Python-2.0": "psf", "MPL-2.0": "mpl-2", "AGPL-3.0-only": "agpl-3", "CC-BY-SA-4.0": "cc-by-sa",
    }
    texts |= {f"SPDX-License-Identifier: {k}": label for k, label in identifiers.items()}
    got = {r.id: r.labels for r in licenses.license_labels(make(enumerate(texts))).collect()}
    assert got == dict(enumerate(texts.values()))


def test_every_alternative_holds_a_keyword_and_passes_the_gate():
    by_rank = {}
    for rank, _, keyword, pattern, _ in licenses.rules():
        by_rank.setdefault(rank, (pattern, set()))[1].add(keyword)
    samples = [name for _, _, name, _ in licenses.LICENSES] + [identifier for _, _, _, identifier in licenses.LICENSES]
    plain = set()
    for sample in samples:
        for part in re.sub(r"\(\?:[^()]*\)[?+]?", "", sample).split("|"):
            part = re.sub(r"\[[^]]*\][?*]", " ", part).replace(r"\b", "").replace(r"\s+", " ").replace(r"\w*", "")
            plain.add(re.sub(r"\[(.)[^]]*\]\+?", r"\1", part).replace(r"\s", " ").replace("\\", "").replace(",?", "").replace("?", "").replace("+", ""))
    texts = [form.format(x) for x in plain for form in ("SPDX-License-Identifier: {}", "released under {}", "see the {} licence", "{} license")]
    fired = set()
    for text in texts:
        for rank, (pattern, keywords) in by_rank.items():
            for match in re.finditer(pattern, text):
                fired.add(rank)
                low = " ".join(match[0].lower().split())
                assert any(k in low for k in keywords), (pattern, match[0])
                assert re.search(licenses.GATE, match[0]), match[0]
    assert len(fired) > 200


def test_base_phrases_beside_underscores_match_brute_force(make):
    texts = ["_CC BY NC 4.0_", "x_cc_by_nc", "see _cc by nc_ and cc_by_nc", "acc by nc", "cc by nc2"]
    got = {r.id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_labels(make(enumerate(texts))).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)} and got[0][1] == 1 and got[2][1] == 2
