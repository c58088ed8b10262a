"""The ordered signature rules of the license scan.

Rules read normalised text: words in lower case, with single spaces between. A rule is
gated by keywords, of which one must occur, from the start of a word, before its expression
runs. Rules are ordered:
sentences that only one license has come first, then tags, links, grants, titles, and
unnamed mentions last. The expressions of tags, links, grants and titles are made from
the hand-written forms below for every license of the table.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    form: str
    keywords: tuple[str, ...]
    pattern: str
    weight: float


# Phrases whose places are counted, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# How sure a single detection of a form makes us; a form's place is its priority.
WEIGHTS = {"body": 0.95, "tag": 0.95, "link": 0.85, "grant": 0.9, "title": 0.6, "mention": 0.4, "base": 0.5}

L = "licen[cs]es?"
V = "(?: version| v)?"
ONLY = "(?: (?:only|or later|or any later version))?"

# label: (keywords, of which one occurs in each name; the name; the link or "")
LICENSES = {
    "apache-1.1": ("apache", f"apache(?: software)?(?: {L})?{V} ?1 1", "apache org licenses license 1 1"),
    "apache-2.0": ("apache|asl", f"(?:apache(?: software)?(?: {L})?|asl){V} ?2(?: 0)?", "apache org licenses license 2 0"),
    "apache": ("apache", f"apache(?: software)? {L}", "apache org licenses"),
    "mit-0": ("mit", f"mit(?: no attribution| 0)(?: {L})?", "opensource org licenses mit 0"),
    "mit": ("mit", f"(?:mit|expat) {L}", "opensource org licenses mit"),
    "isc": ("isc", f"isc {L}", "opensource org licenses isc"),
    "0bsd": ("bsd", f"(?:0bsd|bsd zero clause)(?: {L})?", "opensource org licenses 0bsd"),
    "bsd-2-clause": ("bsd", f"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: {L})?", "opensource org licenses bsd 2 clause"),
    "bsd-3-clause": ("bsd", f"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: {L})?", "opensource org licenses bsd 3 clause"),
    "bsd-4-clause": ("bsd", f"(?:bsd 4 clause|4 clause bsd|original bsd)(?: {L})?", ""),
    "bsd": ("bsd", f"bsd(?: style)? {L}", "opensource org licenses bsd license"),
    "gpl-1.0": ("gpl|gnu general public", f"(?:gnu gpl|gpl|gnu general public {L}){V} ?1(?: 0)?{ONLY}", "gnu org licenses gpl 1 0"),
    "gpl-2.0": ("gpl|gnu general public", f"(?:gnu gpl|gpl|gnu general public {L}){V} ?2(?: 0)?{ONLY}", "gnu org licenses gpl 2 0"),
    "gpl-3.0": ("gpl|gnu general public", f"(?:gnu gpl|gpl|gnu general public {L}){V} ?3(?: 0)?{ONLY}", "gnu org licenses gpl 3 0"),
    "gpl": ("gpl|gnu general public", f"(?:gnu gpl|gnu general public {L}|gpl {L})", "gnu org licenses gpl"),
    "lgpl-2.0": ("lgpl|gnu lesser|gnu library", f"(?:gnu lgpl|lgpl|gnu library general public {L}){V} ?2(?: 0)?{ONLY}", "gnu org licenses lgpl 2 0"),
    "lgpl-2.1": ("lgpl|gnu lesser|gnu library", f"(?:gnu lgpl|lgpl|gnu lesser general public {L}){V} ?2 1{ONLY}", "gnu org licenses lgpl 2 1"),
    "lgpl-3.0": ("lgpl|gnu lesser|gnu library", f"(?:gnu lgpl|lgpl|gnu lesser general public {L}){V} ?3(?: 0)?{ONLY}", "gnu org licenses lgpl 3 0"),
    "lgpl": ("lgpl|gnu lesser|gnu library", f"(?:gnu lgpl|gnu lesser general public {L}|lgpl {L})", "gnu org licenses lgpl"),
    "agpl-3.0": ("agpl|gnu affero", f"(?:gnu agpl|agpl|gnu affero general public {L}){V} ?3(?: 0)?{ONLY}", "gnu org licenses agpl 3 0"),
    "agpl": ("agpl|gnu affero", f"(?:gnu agpl|gnu affero general public {L}|agpl {L})", "gnu org licenses agpl"),
    "gfdl-1.3": ("gnu", f"gnu free documentation {L}{V} ?1 3{ONLY}", "gnu org licenses fdl 1 3"),
    "gfdl": ("gnu", f"gnu free documentation {L}", "gnu org licenses fdl"),
    "mpl-1.1": ("mpl|mozilla public", f"(?:mpl|mozilla public {L}){V} ?1 1", "mozilla org mpl 1 1"),
    "mpl-2.0": ("mpl|mozilla public", f"(?:mpl|mozilla public {L}){V} ?2(?: 0)?", "mozilla org mpl 2 0"),
    "mpl": ("mozilla", f"mozilla public {L}", "mozilla org mpl"),
    "epl-1.0": ("epl|eclipse public", f"(?:epl|eclipse public {L}){V} ?1(?: 0)?", "eclipse org legal epl v10"),
    "epl-2.0": ("epl|eclipse public", f"(?:epl|eclipse public {L}){V} ?2(?: 0)?", "eclipse org legal epl 2 0"),
    "epl": ("eclipse", f"eclipse public {L}", "eclipse org legal"),
    "edl-1.0": ("eclipse", f"eclipse distribution {L}{V}(?: 1 0)?", "eclipse org org documents edl v10"),
    "cddl-1.0": ("cddl|common development", f"(?:cddl|common development and distribution {L}){V} ?1(?: 0)?", "sun com cddl"),
    "cddl-1.1": ("cddl|common development", f"(?:cddl|common development and distribution {L}){V} ?1 1", ""),
    "cpl-1.0": ("common public", f"common public {L}{V}(?: 1 0)?", ""),
    "ipl-1.0": ("ibm public", f"ibm public {L}{V}(?: 1 0)?", ""),
    "eupl-1.1": ("eupl|european union public", f"(?:eupl|european union public {L}){V} ?1 1", ""),
    "eupl-1.2": ("eupl|european union public", f"(?:eupl|european union public {L}){V} ?1 2", "joinup ec europa eu"),
    "artistic-1.0": ("artistic", f"artistic {L}{V} ?1(?: 0)?", "perlfoundation org artistic license 1 0"),
    "artistic-2.0": ("artistic", f"artistic {L}{V} ?2(?: 0)?", "perlfoundation org artistic license 2 0"),
    "artistic": ("artistic", f"artistic {L}", "perlfoundation org artistic"),
    "zlib": ("zlib", f"zlib(?: libpng)? {L}", "zlib net zlib license"),
    "libpng": ("libpng|png", f"(?:lib)?png(?: reference library)? {L}", "libpng org pub png src libpng license"),
    "bsl-1.0": ("boost", f"boost software {L}{V}(?: 1 0)?", "boost org license 1 0"),
    "unlicense": ("unlicense", "the unlicense|unlicensed? software", "unlicense org"),
    "wtfpl": ("wtfpl", "wtfpl(?: version)?(?: 2)?", "wtfpl net"),
    "python-2.0": ("python", f"(?:python software foundation|psf) {L}{V}(?: 2)?", "docs python org 3 license"),
    "php-3.01": ("php", f"php {L}{V}(?: 3 01)?", "php net license"),
    "ruby": ("ruby", f"ruby(?: s)? {L}", "ruby lang org en about license"),
    "openssl": ("openssl", f"openssl {L}", "openssl org source license"),
    "postgresql": ("postgresql", f"postgresql {L}", "postgresql org about licence"),
    "curl": ("curl", f"curl {L}", "curl se docs copyright"),
    "ncsa": ("ncsa", f"(?:university of illinois )?(?:open source )?ncsa(?: open source)? {L}", "otm illinois edu"),
    "vim": ("vim", f"vim {L}", "vimhelp org uganda"),
    "x11": ("x11", f"x11 {L}", "xfree86 org 3 3 6 copyright2"),
    "w3c": ("w3c", f"w3c(?: software)?(?: notice and)? {L}", "w3 org consortium legal"),
    "ofl-1.1": ("ofl|open font", f"(?:ofl|(?:sil )?open font {L}){V}(?: 1 1)?", "scripts sil org ofl"),
    "odbl-1.0": ("odbl|open database", f"(?:odbl|open database {L}){V}(?: 1 0)?", "opendatacommons org licenses odbl"),
    "odc-by-1.0": ("odc by|open data commons", f"(?:odc by|open data commons attribution {L}){V}(?: 1 0)?", "opendatacommons org licenses by"),
    "pddl-1.0": ("pddl|public domain dedication", "pddl|public domain dedication and licen[cs]e", "opendatacommons org licenses pddl"),
    "ms-pl": ("ms pl|microsoft public", f"(?:ms pl|microsoft public {L})", "opensource org licenses ms pl"),
    "ms-rl": ("ms rl|microsoft reciprocal", f"(?:ms rl|microsoft reciprocal {L})", "opensource org licenses ms rl"),
    "osl-3.0": ("osl|open software", f"(?:osl|open software {L}){V} ?3(?: 0)?", "opensource org licenses osl 3 0"),
    "afl-3.0": ("afl|academic free", f"(?:afl|academic free {L}){V} ?3(?: 0)?", "opensource org licenses afl 3 0"),
    "upl-1.0": ("universal permissive", f"universal permissive {L}{V}(?: 1 0)?", "opensource org licenses upl"),
    "mulan-2.0": ("mulan", f"mulan (?:psl|permissive software {L}){V} ?2?", "license coscl org cn mulanpsl2"),
    "sspl-1.0": ("sspl|server side public", f"(?:sspl|server side public {L}){V}(?: ?1)?", "mongodb com licensing server side public license"),
    "busl-1.1": ("busl|business source", f"(?:busl|business source {L}){V}(?: 1 1)?", "mariadb com bsl11"),
    "elastic-2.0": ("elastic", f"elastic {L}{V}(?: 2 0)?", "elastic co licensing elastic license"),
    "openrail-m": ("openrail|open rail", "(?:creativeml |bigscience |big code )?open ?rail(?: m)?(?: licen[cs]e)?", ""),
    "llama": ("llama", f"llama(?: [23](?: [123])?)?(?: community)? {L}", "ai meta com llama license"),
    "cc0-1.0": ("cc0|cc zero|creative commons zero", "(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "creativecommons org publicdomain zero"),
    "cc-by-nc-nd-4.0": ("cc by|creative commons", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?) 4 0", "creativecommons org licenses by nc nd 4 0"),
    "cc-by-nc-sa-4.0": ("cc by|creative commons", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0", "creativecommons org licenses by nc sa 4 0"),
    "cc-by-nc-4.0": ("cc by|creative commons", "(?:cc by nc|creative commons attribution non ?commercial) 4 0", "creativecommons org licenses by nc 4 0"),
    "cc-by-nd-4.0": ("cc by|creative commons", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?) 4 0", "creativecommons org licenses by nd 4 0"),
    "cc-by-sa-4.0": ("cc by|creative commons", "(?:cc by sa|creative commons attribution share ?alike) 4 0", "creativecommons org licenses by sa 4 0"),
    "cc-by-sa-3.0": ("cc by|creative commons", "(?:cc by sa|creative commons attribution share ?alike) 3 0", "creativecommons org licenses by sa 3 0"),
    "cc-by-4.0": ("cc by|creative commons", "(?:cc by|creative commons attribution) 4 0", "creativecommons org licenses by 4 0"),
    "cc-by-3.0": ("cc by|creative commons", "(?:cc by|creative commons attribution) 3 0", "creativecommons org licenses by 3 0"),
    "cc-by-nc": ("cc by|creative commons", "cc by nc(?: sa| nd)?|creative commons attribution non ?commercial", "creativecommons org licenses by nc"),
    "cc-by-sa": ("cc by|creative commons", "cc by sa|creative commons attribution share ?alike", "creativecommons org licenses by sa"),
    "cc-by-nd": ("cc by|creative commons", "cc by nd|creative commons attribution no ?deriv(?:ative)?s?", "creativecommons org licenses by nd"),
    "creative-commons": ("creative commons", f"creative commons(?: {L})?", "creativecommons org"),
}

# Sentences that one license, or one family, has: (label, keyword, words).
BODIES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "notice and this permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause", "used to endorse", "(?:neither the name of(?: [^ ]+){1,12}|the names? of(?: [^ ]+){1,12} may not) be used to endorse or promote products"),
    ("bsd-2-clause", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2.0", "apache license", "you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)?"),
    ("apache-2.0", "apache license", "apache license version 2 0 january 2004"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl-2.0", "version 2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "version 3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "version 2 june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-3.0", "version 3 29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("agpl-3.0", "version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("lgpl-2.1", "version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3.0", "lesser general public", "gnu lesser general public license version 3 29 june 2007"),
    ("gpl", "free software foundation", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "lesser general public", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "affero general public", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "should have received a copy", "you should have received a copy of the gnu general public license along with this"),
    ("lgpl", "should have received a copy", "you should have received a copy of the gnu lesser general public license along with this"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "eclipse public", "made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "eclipse public", "made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", "common development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1.0", "boost software", "distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the", "do what the (?:fuck|f[^ ]* )you want to public license"),
    ("artistic-2.0", "artistic license", "the artistic license 2 0 copyright"),
    ("python-2.0", "python software foundation", "this license agreement is between the python software foundation"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ofl-1.1", "open font", "this font software is licensed under the sil open font license"),
    ("cc0-1.0", "cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "waived all copyright", "(?:has )?waived all copyright and related or neighboring rights"),
    ("public-domain", "public domain", "(?:released|placed|dedicated|put|published) (?:in|into|to) the public domain"),
    ("ms-pl", "microsoft public", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("busl-1.1", "business source", "business source license 1 1 parameters"),
    ("elastic-2.0", "elastic license", "you may not provide the software to third parties as a hosted or managed service"),
    ("openrail-m", "use based restrictions", "use based restrictions as referenced in paragraph 5"),
]

# Notices without a named license, last of all: (label, keyword, words).
MENTIONS = [
    ("warranty-disclaimer", "warrant", "without warrant(?:y|ies)(?: or conditions)? of any kind(?: (?:either )?express(?:ed)? or implied)?"),
    ("warranty-disclaimer", "merchantability", "(?:the )?implied warrant(?:y|ies) of merchantability(?: and| or) fitness for a particular purpose"),
    ("warranty-disclaimer", "as is", "provided (?:by the [^ ]+(?: [^ ]+){0,4} )?as is"),
    ("public-domain", "public domain", "(?:this work |it )?is in the public domain"),
    ("public-domain", "public domain", "public domain(?: mark| dedication)"),
    ("no-derivatives", "prior written", "(?:reproduction|redistribution|copying)(?: [^ ]+){0,6} without(?: the)?(?: express)? prior written (?:permission|consent)"),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential|proprietary software)"),
    ("proprietary", "unauthori", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){0,6} (?:is )?(?:strictly )?prohibited"),
    ("proprietary", "end user", f"end user {L}(?: agreement)?"),
    ("non-commercial", "noncommercial|non commercial", "(?:for )?non ?commercial (?:use|purposes) only"),
    ("non-commercial", "commercial", "(?:may|must) not be used for commercial purposes"),
    ("attribution", "give appropriate credit", "you must give appropriate credit"),
    ("copyright-notice", "copyright", "(?:c )?copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("copyright-notice", "copyright", "copyright (?:holders?|owners?|notice)"),
    ("copyright-notice", "reserved", "(?:some|no) rights reserved"),
    ("license-reference", "licen", f"(?:licensed|released|distributed|published|available) under (?:the |an? )?(?:[^ ]+ ){{1,4}}?{L}"),
    ("license-reference", "licen", f"(?:see|read)(?: the)? {L}(?: file)? for (?:details|more information|terms)"),
    ("license-reference", "licen", f"under the terms of (?:the|this|an?) {L}"),
    ("license-reference", "license identifier", "spdx license identifier [^ ]+"),
]

# The hand-written forms that every license of the table takes.
GRANT = (
    "(?:dual |is |are |be )?(?:licensed|released|distributed|published|available|provided|covered|offered|shared)(?: to you)? (?:under|by|subject to)"
    "(?: the)?(?: (?:terms|conditions)(?: and conditions)? of)?(?: the)?(?: an?)? (?:{name})"
)
TITLE = "(?:{name})"
TAG = "spdx license identifier {tag}(?: only| or later)?"
DECLARED = "{word} {tag}(?: only| or later)?"
LINK = "(?:https? )?(?:www )?{link}(?: (?:html|txt|php|legalcode|deed))?"


def rules() -> list[Rule]:
    """All rules, those of higher priority first; base phrases are none of them."""
    made = [Rule(label, "body", tuple(keywords.split("|")), words, WEIGHTS["body"]) for label, keywords, words in BODIES]
    for label in LICENSES:
        tag = label.replace("-", " ").replace(".", " ")
        made.append(Rule(label, "tag", ("spdx license identifier",), TAG.format(tag=tag), WEIGHTS["tag"]))
    for label, (_, _, link) in LICENSES.items():
        if link:
            made.append(Rule(label, "link", (link,), LINK.format(link=link), WEIGHTS["link"]))
    for form, shape in (("grant", GRANT), ("title", TITLE)):
        for label, (keywords, name, _) in LICENSES.items():
            made.append(Rule(label, form, tuple(keywords.split("|")), shape.format(name=name), WEIGHTS[form]))
    for label in LICENSES:
        tag = label.replace("-", " ").replace(".", " ")
        made += [Rule(label, "title", (f"{word} {tag}",), DECLARED.format(word=word, tag=tag), WEIGHTS["title"]) for word in ("license", "licence", "licensed as")]
    return made + [Rule(label, "mention", tuple(keywords.split("|")), words, WEIGHTS["mention"]) for label, keywords, words in MENTIONS]
