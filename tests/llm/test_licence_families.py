"""Notices of the GNU family are told apart."""

from __future__ import annotations

import pytest

from carefold.llm import licences


@pytest.mark.parametrize("kind, name", [("", "GPL-3.0"), ("Lesser ", "LGPL-3.0"), ("Affero ", "AGPL-3.0")])
@pytest.mark.parametrize("notice", ["This work is licensed under the GNU {0}General Public License, version 3", None])
def test_gnu_licences_are_told_apart(kind, name, notice):
    notice = notice or licences.TEMPLATES[6][1].replace("GNU General", "GNU {0}General")
    known = licences.Templates(licences.TEMPLATES, licences.DICE)
    assert [r[0] for r in licences.best_runs(notice.format(kind).encode(), known)] == [name]


def test_long_runs_of_repeated_lines():
    """Lines that add nothing to a run are skipped, so repeats cost no more than their number, and results stay those of the plain loop."""
    import random
    import time

    known = licences.Templates(licences.TEMPLATES, licences.DICE)
    r = random.Random(3)

    class Plain(licences._Fresh):
        def after(self, j, i):
            return j + 1

    def plain(text):
        kept, licences._Fresh = licences._Fresh, Plain
        try:
            return licences.best_runs(text, known)
        finally:
            licences._Fresh = kept

    found = 0
    for _ in range(200):
        words, lines = r.choice(licences.TEMPLATES)[1].split(), []
        while words:
            n = r.randint(1, 9)
            lines.append(" ".join(words[:n]))
            words = words[n:]
            if r.random() < 0.3:
                lines.append(r.choice(["", "other words", lines[0], lines[-1]]))
        text = "\n".join(lines * r.randint(1, 3)).encode()
        assert licences.best_runs(text, known) == plain(text)
        found += bool(plain(text))
    assert found > 100
    start = time.perf_counter()
    licences.best_runs((licences.TEMPLATES[0][1].split(".")[0] + "\n").encode() * 20000, known)
    assert time.perf_counter() - start < 60
