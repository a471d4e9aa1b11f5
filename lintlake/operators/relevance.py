"""Why a weakness matters before a fix for it is known: one sentence for each CWE that the rules report."""

from __future__ import annotations

RELEVANCE = {
    "CWE-22": "Paths from outside reach files that no list of patched versions covers.",
    "CWE-61": "A link planted at the right moment redirects a trusted write.",
    "CWE-73": "Whoever chooses the file name chooses what is overwritten.",
    "CWE-78": "One value in a command line is enough to run any program.",
    "CWE-89": "Injected SQL works whatever the version of the database.",
    "CWE-90": "Filters built from text open a directory to anyone.",
    "CWE-93": "Line ends in headers split responses and poison caches.",
    "CWE-94": "Evaluated text turns any input bug into code execution.",
    "CWE-114": "A library loaded from a writable place runs before any check.",
    "CWE-117": "Forged log lines hide an attack from those who look for it.",
    "CWE-134": "A format from outside reads attributes that were never meant to be shown.",
    "CWE-158": "A null byte ends a string for one layer and not for the next.",
    "CWE-200": "Stack traces tell an attacker versions and paths.",
    "CWE-208": "Comparison times give a secret away byte by byte.",
    "CWE-295": "Without certificate checks every network on the way can answer.",
    "CWE-322": "An unknown host key accepted once is a listener accepted for good.",
    "CWE-326": "Old protocol versions can be downgraded to and broken.",
    "CWE-327": "Broken ciphers fail against recorded traffic too.",
    "CWE-328": "Collisions in broken hashes let one file stand in for another.",
    "CWE-338": "Predictable numbers make predictable tokens.",
    "CWE-377": "A guessed temporary name is taken before it is used.",
    "CWE-391": "An error that nobody sees is an attack that nobody sees.",
    "CWE-453": "An insecure default reaches every caller that doesn't know of it.",
    "CWE-489": "Debug consoles are remote code execution by design.",
    "CWE-502": "Crafted data runs code when it is loaded, before any validation.",
    "CWE-532": "Logs are copied to places where secrets were never meant to go.",
    "CWE-601": "A trusted address lends its name to a hostile one.",
    "CWE-611": "External entities read local files and reach inner networks.",
    "CWE-617": "Checks by assertion are gone as soon as Python optimises.",
    "CWE-770": "One large request can take all memory.",
    "CWE-778": "What isn't logged can't be traced after a break-in.",
    "CWE-798": "A credential in the source is known to everyone who has a copy.",
    "CWE-829": "Code from a start-up file runs in every process of the installation.",
    "CWE-918": "Requests to chosen addresses reach services behind the wall.",
    "CWE-1007": "What reviewers read isn't what runs.",
    "CWE-1088": "A peer that never answers stops the service.",
    "CWE-1104": "Components that nobody pins or maintains bring in tomorrow's holes.",
    "CWE-1327": "A service on all interfaces is open to networks it was never meant for.",
    "CWE-1333": "One crafted string keeps a processor busy for hours.",
    "CWE-1336": "A template made from input is code made from input.",
}
