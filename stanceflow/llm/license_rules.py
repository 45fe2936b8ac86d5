"""Ordered signature rules for license scans.

Patterns match the words of a text (lower case, joined by single spaces), so
"Apache-2.0" reads "apache 2 0". Each line of ``NAMES`` is written by hand:

    label | pattern of the license's full names | words of its tag

A rule's keyword is derived from its pattern: literals of which every match has
at least one. Four rules come from a line: a machine-readable tag, a grant ("licensed under
...", "... applies"), a link, and the name standing as a name. ``TEXTS`` holds
sentences of the licenses' bodies and notices.
"""

from __future__ import annotations

from re import _constants as ops
from re import _parser as parser
from typing import NamedTuple


class Signature(NamedTuple):
    """Higher priority first; ``phrase`` rules are the fixed base. ``keyword``:
    literals, joined by ``|``, of which every match holds at least one."""

    label: str
    priority: int
    keyword: str
    pattern: str


# The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

NAMES = """
mit | (?:mit|expat) (?:license|licence|lizenz|licencia)|(?:license|licence|lizenz|licencia|licenza) mit|x11 mit license | mit
mit-0 | mit no attribution(?: license)?|mit zero license | mit 0
apache-2 | apache (?:software )?licen[sc]e(?: version| v)? 2(?: 0)?|asl 2 0|apache 2 0 licen[sc]e | apache 2 0
apache-1.1 | apache (?:software )?licen[sc]e(?: version| v)? 1 1 | apache 1 1
apache-1.0 | apache (?:software )?licen[sc]e(?: version| v)? 1 0 | apache 1 0
gpl-2 | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?! 1) | gpl 2 0(?: only| or later)?
gpl-3 | gnu general public licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3 | gpl 3 0(?: only| or later)?
gpl-1 | gnu general public licen[sc]e(?: either)? (?:version|v) ?1 | gpl 1 0(?: only| or later)?
gpl | gnu general public licen[sc]e|gnu gpl | gpl
lgpl-2.1 | (?:gnu )?lesser general public licen[sc]e(?: either)? (?:version|v) ?2 1 | lgpl 2 1(?: only| or later)?
lgpl-2 | (?:gnu )?library general public licen[sc]e(?: either)? (?:version|v) ?2 | lgpl 2 0(?: only| or later)?
lgpl-3 | (?:gnu )?lesser general public licen[sc]e(?: either)? (?:version|v) ?3 | lgpl 3 0(?: only| or later)?
lgpl | (?:gnu )?lesser general public licen[sc]e | lgpl
agpl-3 | (?:gnu )?affero general public licen[sc]e(?: either)?(?: version| v)? ?3? | agpl 3 0(?: only| or later)?
fdl-1.3 | gnu free documentation licen[sc]e(?: version)? 1 3 | gfdl 1 3(?: only| or later)?
fdl | gnu free documentation licen[sc]e | gfdl(?: 1 [12])?(?: only| or later)?
bsd-2-clause | (?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)? | bsd 2 clause
bsd-3-clause | (?:modified|revised|new|3 clause|three clause) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)? | bsd 3 clause
bsd-4-clause | (?:original|old|4 clause|four clause) bsd licen[sc]e|bsd 4 clause(?: licen[sc]e)? | bsd 4 clause
bsd-0 | zero clause bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)? | 0bsd
bsd | bsd (?:style )?licen[sc]e|bsd licensed | bsd
isc | isc licen[sc]e|internet systems consortium licen[sc]e | isc
mpl-2 | mozilla public licen[sc]e(?: version| v)? 2(?: 0)? | mpl 2 0
mpl-1.1 | mozilla public licen[sc]e(?: version| v)? 1 1 | mpl 1 1
mpl | mozilla public licen[sc]e | mpl
epl-2 | eclipse public licen[sc]e(?: version| v)? 2(?: 0)? | epl 2 0
epl-1 | eclipse public licen[sc]e(?: version| v)? 1(?: 0)? | epl 1 0
edl-1 | eclipse distribution licen[sc]e(?: version| v)? 1(?: 0)? | edl 1 0
cddl-1 | common development and distribution licen[sc]e(?: version)?(?: 1 0)? | cddl 1 0
cpl-1 | common public licen[sc]e(?: version)? 1(?: 0)? | cpl 1 0
ipl-1 | ibm public licen[sc]e(?: version)?(?: 1 0)? | ipl 1 0
cc0 | cc0 1 0 universal|cc0 1 0|cc0 public domain dedication | cc0 1 0
cc-by | cc by(?: [1-4] 0)?(?! nc| sa| nd)(?= |$) | cc by [1-4] 0
cc-by | creative commons attribution(?: [1-4] 0)?(?! non| share| no)(?: international| unported| generic)?(?: public)? licen[sc]e | cc by
cc-by-sa | cc by sa(?: [1-4] 0)? | cc by sa [1-4] 0
cc-by-sa | creative commons attribution share ?alike(?: [1-4] 0)? | cc by sa
cc-by-nc | cc by nc(?: [1-4] 0)?(?! sa| nd) | cc by nc [1-4] 0
cc-by-nc | creative commons attribution non ?commercial(?: [1-4] 0)?(?! share| no) | cc by nc
cc-by-nd | cc by nd(?: [1-4] 0)? | cc by nd [1-4] 0
cc-by-nd | creative commons attribution no ?deriv(?:ative|atives|s)?(?: [1-4] 0)? | cc by nd
cc-by-nc-sa | cc by nc sa(?: [1-4] 0)? | cc by nc sa [1-4] 0
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike(?: [1-4] 0)? | cc by nc sa
cc-by-nc-nd | cc by nc nd(?: [1-4] 0)? | cc by nc nd [1-4] 0
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)?(?: [1-4] 0)? | cc by nc nd
unlicense | the unlicense|unlicense org | unlicense
wtfpl | wtfpl(?: version 2)?|do what the fuck you want to public licen[sc]e | wtfpl
zlib | zlib(?: libpng)? licen[sc]e | zlib
libpng | libpng licen[sc]e(?: version 2)? | libpng(?: 2 0)?
boost-1 | boost software licen[sc]e(?: version)?(?: 1 0)? | bsl 1 0
artistic-2 | artistic licen[sc]e(?: version)? 2(?: 0)? | artistic 2 0
artistic-1 | artistic licen[sc]e(?: version)? 1(?: 0)?|the artistic licen[sc]e | artistic 1 0
python-2 | python software foundation licen[sc]e(?: version)?(?: 2)?|psf licen[sc]e(?: agreement)? | python 2 0|psf 2 0
php-3 | php licen[sc]e(?: version)? 3(?: 01)? | php 3 01?
ruby | ruby licen[sc]e|ruby s licen[sc]e | ruby
postgresql | postgresql licen[sc]e | postgresql
openssl | openssl(?: and ssleay)? licen[sc]e | openssl
ofl-1.1 | sil open font licen[sc]e(?: version)?(?: 1 1)?|open font licen[sc]e(?: version)?(?: 1 1)? | ofl 1 1
eupl-1.2 | european union public licen[sc]e(?: version| v)?(?: 1 [12])? | eupl 1 [12]
cecill-2.1 | cecill(?: free software)? licen[sc]e(?: agreement)?(?: version)?(?: 2 1)?|licence cecill | cecill 2 1
odbl-1 | open database licen[sc]e(?: version| v)?(?: 1 0)? | odbl 1 0
odc-by-1 | open data commons attribution licen[sc]e(?: v)?(?: 1 0)? | odc by 1 0
pddl-1 | open data commons public domain dedication(?: and)? licen[sc]e | pddl 1 0
ms-pl | microsoft public licen[sc]e | ms pl
ms-rl | microsoft reciprocal licen[sc]e | ms rl
ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e | ncsa
afl-3 | academic free licen[sc]e(?: version| v)?(?: 3 0)? | afl 3 0
osl-3 | open software licen[sc]e(?: version| v)?(?: 3 0)? | osl 3 0
upl-1 | universal permissive licen[sc]e(?: version| v)?(?: 1 0)? | upl 1 0
qpl-1 | q public licen[sc]e(?: version)?(?: 1 0)? | qpl 1 0
busl-1.1 | business source licen[sc]e(?: version)?(?: 1 1)? | busl 1 1
sspl-1 | server side public licen[sc]e(?: version)?(?: 1)? | sspl 1 0
elastic-2 | elastic licen[sc]e(?: version)? 2(?: 0)? | elastic 2 0
polyform | polyform (?:noncommercial|shield|small business|strict) licen[sc]e(?: 1 0 0)? | polyform noncommercial 1 0 0
mulan-2 | mulan (?:psl|permissive software licen[sc]e)(?: v| version)? ?2 | mulanpsl 2 0
bluebsd | blue oak model licen[sc]e(?: 1 0 0)? | blueoak 1 0 0
openrail | (?:creativeml |bigcode )?open ?rail(?: m)?(?: licen[sc]e)? | (?:creativeml )?openrail m?
llama | llama [23](?: [0-9])? community licen[sc]e(?: agreement)? | llama[23]
vim | vim licen[sc]e | vim
beerware | beerware|beer ware licen[sc]e | beerware
gust-font | gust font licen[sc]e | gust font license
tcl | tcl tk licen[sc]e | tcl
w3c | w3c software(?: notice and)? licen[sc]e | w3c
jpl | jpl image use policy | jpl image
ogl-uk | open government licen[sc]e(?: v| version)?(?: ?[123] 0)? | ogl uk [123] 0
"""

TEXTS = """
mit | 55 | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 45 | the above copyright notice and this permission notice shall be included in all copies
isc | 55 | permission to use copy modify and or distribute this software for any purpose with or without fee
apache-2 | 55 | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2 | 50 | apache org licenses license 2 0
gpl | 55 | this (?:program|library|software|file) is free software you can redistribute it and or modify it under the terms of the gnu
gpl | 45 | distributed in the hope that it will be useful but without any warranty
gpl | 50 | you should have received a copy of the gnu general public licen[sc]e
lgpl | 52 | you should have received a copy of the gnu lesser general public licen[sc]e
agpl-3 | 52 | you should have received a copy of the gnu affero general public licen[sc]e
bsd | 55 | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | 58 | neither the name of(?: (?!neither the name of |this software is provided |redistributions? (?:of|in) )[^ ]+)+? may be used to endorse or promote products
bsd-4-clause | 58 | all advertising materials mentioning features or use of this software must display
mpl-2 | 55 | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
epl-2 | 55 | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
zlib | 55 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
boost-1 | 55 | distributed under the boost software licen[sc]e version 1 0
unlicense | 55 | this is free and unencumbered software released into the public domain
cc0 | 52 | (?:has )?waived all copyright and related or neighboring rights
ofl-1.1 | 55 | with reserved font name
wtfpl | 50 | you just do what the
artistic-2 | 50 | intent of this document is to state the conditions under which a package may be copied
beerware | 50 | you can buy me a beer in return
public-domain | 40 | (?:is|are|been|placed|dedicated|released)(?: hereby)?(?: in| into| to)? the public domain
all-rights-reserved | 20 | all rights reserved
proprietary | 30 | proprietary and confidential
proprietary | 30 | unauthorized copying of this (?:file|document|work)
non-commercial | 30 | (?:for )?non commercial use only|not for commercial use
"""

TAG = r"spdx licen[sc]e identifier (?:{tag})"
GRANT = (r"(?:licensed|released|distributed|available|published|provided|covered|governed|redistributed)"
         r"(?: under| by| with)(?: the)?(?: terms of(?: the)?)? (?:{name})")
LINK = (r"(?:opensource org licen[sc]es?|spdx org licen[sc]es|choosealicense com licen[sc]es"
        r"|creativecommons org licen[sc]es|gnu org licen[sc]es) (?:{tag})")
STAND = r"(?:{name})"


#: Most strings that a part of a pattern is spelled out to.
SPELLED = 64


def keyword(pattern: str) -> str:
    """The longest literals found of which every match of ``pattern`` holds at
    least one, joined by ``|`` (words have no such character). A space, which
    is in every line, if the pattern needs no literal."""
    need = _needs(parser.parse(pattern))[1]
    return " " if "" in need else "|".join(sorted(need))


def _better(a: set[str], b: set[str]) -> set[str]:
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _needs(parts) -> tuple[set[str] | None, set[str]]:
    """All strings that a sequence matches (None: too many to spell out), and
    strings of which every match holds at least one."""
    whole, run, best = True, {""}, {""}
    for op, arg in parts:
        exact, need = _node(op, arg)
        best = _better(best, need)
        if exact is not None and len(run) * len(exact) <= SPELLED:
            run = {x + y for x in run for y in exact}
        else:
            whole, best, run = False, _better(best, run), exact or {""}
    return run if whole else None, _better(best, run)


def _node(op, arg) -> tuple[set[str] | None, set[str]]:
    exact, need = None, {""}
    if op is ops.LITERAL:
        exact = need = {chr(arg)}
    elif op in (ops.ASSERT, ops.ASSERT_NOT, ops.AT):  # no width
        exact = need
    elif op is ops.IN and all(kind in (ops.LITERAL, ops.RANGE) for kind, _ in arg):
        chars = [range(x, x + 1) if kind is ops.LITERAL else range(x[0], x[1] + 1) for kind, x in arg]
        if sum(map(len, chars)) <= SPELLED:
            exact = need = {chr(c) for r in chars for c in r}
    elif op is ops.SUBPATTERN and not arg[1] and not arg[2]:
        exact, need = _needs(arg[3])
    elif op is ops.BRANCH:
        ways = [_needs(way) for way in arg[1]]
        need = set().union(*[n for _, n in ways])
        if all(e is not None for e, _ in ways) and sum(len(e) for e, _ in ways) <= SPELLED:
            exact = set().union(*[e for e, _ in ways])
    elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
        least, most, part = arg
        once, inner = _needs(part)
        need = inner if least else need
        if (least, most) == (0, 1) and once is not None:
            exact = once | {""}
    return exact, need


def signatures() -> list[Signature]:
    """All rules, by falling priority; the order within one is the writing order."""
    rules = [Signature(label, 100, words, words) for words, label in BASE]
    for line in filter(None, NAMES.split("\n")):
        label, rest = line.split(" | ", 1)
        name, _, tag = rest.rpartition(" | ")
        tagged, linked = TAG.format(tag=tag), LINK.format(tag=tag)
        rules += [
            Signature(label, 95, keyword(tagged), tagged),
            Signature(label, 85, keyword(name), GRANT.format(name=name)),
            Signature(label, 70, keyword(linked), linked),
            Signature(label, 60, keyword(name), STAND.format(name=name)),
        ]
    for line in filter(None, TEXTS.split("\n")):
        label, priority, pattern = line.split(" | ", 2)
        rules.append(Signature(label, int(priority), keyword(pattern), pattern))
    return sorted(rules, key=lambda r: -r.priority)
