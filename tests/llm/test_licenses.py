"""License scan against a plain Python restatement of its rules."""

import random
import re

from phredlens.llm import licenses as lic
from phredlens.llm.license_rules import ROOTS, rules


def settled(matches):
    """The matches that stay, worked out from what it means to stay: nothing better that stays overlaps it. Decided by
    looking back at better ranks, with no running state."""
    rank = {m: (m[2], m[0] - m[1], m[0], m[3]) for m in matches}
    stays = {}

    def decided(m):
        if m not in stays:
            stays[m] = not any(rank[n] < rank[m] and n[0] < m[1] and m[0] < n[1] and decided(n) for n in matches)
        return stays[m]

    return sorted(m for m in set(matches) if decided(m))


def plain(text, known):
    low = (text or "").lower()
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = [(i, label) for phrase, label in lic.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = sorted((m.start(), -m.end(), k, r.label, r.confidence) for k, r in enumerate(known) if r.keyword in low for m in re.finditer(r.regex, low, re.ASCII))
    kept = [(start, -stop, k, label, confidence) for start, stop, k, label, confidence in found]
    kept = settled(kept)
    labels = sorted({x for _, x in base})
    every = sorted({*labels, *(m[3] for m in kept)})
    at = [i for i, _ in base]
    score = max([0.0, *(m[4] for m in kept), *[0.5] * bool(base)])
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(labels), ",".join(every), score, kept


PARTS = ["Released under the MIT License.", "mit  license", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-3.0-or-later", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "https://creativecommons.org/licenses/by-sa/4.0", "permit licenses", "naïve é", "12", "\n", "dual-licensed", "the unlicense", "All rights reserved", "(c) Acme, all rights reserved", "GPLv2+", "general public-license", "BSD License", "3-clause BSD license", "mit", "license"]


def test_matches_plain_rules(spark):
    rng = random.Random(1)
    known = rules()
    texts = [rng.choice([" ", "", "\n", "; "]).join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(250)] + [None, "", "x " * 100_000 + "MIT license", "mit license " * 300]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "MIT License", "x")], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in lic.license_scan(docs).collect()}
    assert len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        r, want = rows[i], plain(t, known)
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [(s.start, s.stop, s.priority, s.label, s.confidence) for s in r.spans])
        assert got == want, repr(t)
    assert lic.license_scan(docs.limit(0)).count() == 0


def test_a_suppressed_match_suppresses_nothing(spark):
    """A is suppressed by C, so B, which lies in A, stays; a contained match of worse rank goes with its container."""
    spans = {
        "three": ([(0, 10, 5, "a"), (1, 3, 6, "b"), (8, 15, 1, "c")], ["b", "c"]),
        "inside": ([(0, 10, 1, "a"), (1, 3, 6, "b")], ["a"]),
        "inside but better": ([(0, 10, 6, "a"), (1, 3, 1, "b")], ["b"]),
        "chain": ([(0, 4, 3, "a"), (3, 8, 2, "b"), (7, 12, 1, "c")], ["a", "c"]),
        "longer of equal rank": ([(0, 4, 2, "a"), (2, 9, 2, "b")], ["b"]),
        "touching": ([(0, 4, 2, "a"), (4, 9, 1, "b")], ["a", "b"]),
        "none": ([], []),
    }
    rows = [(name, [(*m, 0.5) for m in matches]) for name, (matches, _) in spans.items()]
    frame = spark.createDataFrame(rows, f"name string, m {lic._MATCH}")
    got = {r.name: [m.label for m in r.kept] for r in frame.select("name", lic.resolved(lic.F.col("m")).alias("kept")).collect()}
    assert got == {name: want for name, (_, want) in spans.items()}


def test_rules_are_many_and_gated(spark):
    known = rules()
    assert len(known) >= 200
    assert all(any(root in r.keyword for root in ROOTS) for r in known)
    for r in known:
        re.compile(r.regex)
    by_label = {r.label for r in known}
    assert {"mit", "apache", "gpl", "cc-by-nc", "gpl-3.0", "apache-2.0"} <= by_label


def test_plan_has_no_python_and_no_shuffle(spark, sf_dir):
    plan = lic.license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


ADDRESSES = """apache-2.0 apache.org/licenses/LICENSE-2.0; apache-1.1 apache.org/licenses/LICENSE-1.1; agpl-3.0 gnu.org/licenses/agpl-3.0; agpl-1.0 affero.org/oagpl.html
lgpl-3.0 gnu.org/licenses/lgpl-3.0; gpl-2.0 gnu.org/licenses/old-licenses/gpl-2.0; mit-0 github.com/aws/mit-0; mit opensource.org/licenses/MIT; x11 x.org/Downloads_terms
bsd-4-clause directory.fsf.org/wiki/License:BSD-4Clause; 0bsd landley.net/toybox/license; isc isc.org/licenses; mpl-2.0 mozilla.org/MPL/2.0/; mpl-1.1 mozilla.org/MPL/MPL-1.1
epl-2.0 eclipse.org/legal/epl-2.0; epl-1.0 eclipse.org/legal/epl-v10; cddl-1.1 glassfish.java.net/public/CDDL; eupl-1.2 joinup.ec.europa.eu/collection/eupl; eupl-1.1 ec.europa.eu/idabc/eupl
bsl-1.0 boost.org/LICENSE_1_0.txt; zlib zlib.net/zlib_license; libpng libpng.org/pub/png/src/libpng-LICENSE; openssl openssl.org/source/license; postgresql postgresql.org/about/licence
python-2.0 python.org/3/license; php-3.01 php.net/license/3_01; ruby ruby-lang.org/en/about/license; ofl-1.1 scripts.sil.org/OFL; odbl-1.0 opendatacommons.org/licenses/odbl
odc-by-1.0 opendatacommons.org/licenses/by; pddl-1.0 opendatacommons.org/licenses/pddl; w3c w3.org/Consortium/Legal/2015/copyright-software-and-document-license
wtfpl wtfpl.net; unlicense unlicense.org; sspl-1.0 mongodb.com/licensing/server-side-public-license; busl-1.1 mariadb.com/bsl11; elastic-2.0 elastic.co/licensing/elastic-license
cc0-1.0 creativecommons.org/publicdomain/zero/1.0; cc-by-sa creativecommons.org/licenses/by-sa/4.0"""


def test_each_address_gives_its_label(spark):
    written = [a.split() for a in re.split("[;\\n]", ADDRESSES)]
    docs = spark.createDataFrame([(i, f"see https://{address}") for i, (_, address) in enumerate(written)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in lic.license_scan(docs).collect()}
    assert {i: label for i, (label, _) in enumerate(written) if label not in got[i][0].split(",") or got[i][1] < 0.75} == {}


def test_no_rule_is_left_out():
    from phredlens.llm import license_rules

    known = rules()
    for line in license_rules._LICENSES.strip().splitlines():
        label, *_, keyword, address = [x.strip() for x in line.split(" | ")]
        assert any((r.label, r.keyword, r.regex) == (label, keyword, address) for r in known)


def test_loose_rules_swallow_no_name(spark):
    want = {
        "Licensed under the ISC license or the zlib license": ({"isc", "zlib"}, 0.95),
        "Released under the X11 license and the OpenSSL license": ({"x11", "openssl"}, 0.95),
        "(c) 2020 Acme. Licensed under the ISC license. All rights reserved": ({"isc"}, 0.95),
        "Released under the Acme license": ({"unknown-license"}, 0.3),
        "Released under the Acme license and the MIT license": ({"mit", "unknown-license"}, 0.75),
        "Copyright 2020 Acme. All rights reserved": ({"proprietary"}, 0.6),
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in lic.license_scan(docs).collect()}
    assert got == dict(enumerate(want.values()))
