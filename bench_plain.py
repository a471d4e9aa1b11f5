"""Files a second of our own rules in one thread of plain Python, to compare the scan with: line rules by `re`, facts by `ast`, no Spark.

It tests every line of every file against every line rule and parses every Python file, and leaves out rule assembly, order and filters.
"""

from __future__ import annotations

import json
import re
import time

from lintlake import corpus
from lintlake.functions import predicates as p
from lintlake.operators.facts import facts
from lintlake.operators.text_rules import TEXT_RULES

FILES = 4000


def test_of(when: p.Predicate):
    """A predicate as a Python function of a stripped line; facts hold for none."""
    match when:
        case p.Match(pattern, ignore_case):
            search = re.compile(pattern, re.IGNORECASE if ignore_case else 0).search
            return lambda line: search(line) is not None
        case p.Has(text, lower):
            return lambda line: text in (line.lower() if lower else line)
        case p.Starts(text):
            return lambda line: line.startswith(text)
        case p._Not(of):
            inner = test_of(of)
            return lambda line: not inner(line)
        case p._Both(left, right, word):
            a, b = test_of(left), test_of(right)
            return (lambda line: a(line) and b(line)) if word == "AND" else (lambda line: a(line) or b(line))
    return lambda line: False


def main() -> None:
    slots = [(r.comments, [test_of(c.when) for c in slot]) for r in TEXT_RULES for slot in r.slots]
    texts = [(s.text, not s.label) for s in corpus.SNIPPETS]
    began, found, lines = time.perf_counter(), 0, 0
    for k in range(FILES):
        text, python = texts[k % len(texts)]
        for line in text.splitlines():
            code, lines = line.strip(), lines + 1
            for comments, cases in slots:
                if comments or not code.startswith("#"):
                    found += any(case(code) for case in cases)
        if python:
            facts(text)
    spent = time.perf_counter() - began
    print(json.dumps({"metric": "files_per_second", "value": round(FILES / spent, 1), "unit": "files/s", "lines_per_second": round(lines / spent, 1), "files": FILES, "findings": found}))


if __name__ == "__main__":
    main()
