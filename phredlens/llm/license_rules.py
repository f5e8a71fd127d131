"""Ordered signature rules of the license scan: hand-written regular expressions over lower-cased text.

Every rule has a keyword that each of its matches contains, and every keyword contains one of ``ROOTS``. A text
without a root is passed over at once, a rule whose keyword is missing isn't tried. Earlier rules have priority.
"""

from __future__ import annotations

from typing import NamedTuple

#: Any keyword contains one of these.
ROOTS = ("licen", "spdx", "creativecommons", "creative commons", "public domain", "permission", "redistribut", "cc by", "cc-by", "cc0", "copyleft", "gnu.org", "warrant", "wtfpl", "rights reserved", "unlicense", "gpl", "affero.org", "aws/mit-0", "x.org/downloads", "mozilla.org", "eclipse.org/legal", "glassfish", "eupl", "libpng.org", "python.org", "ruby-lang", "sil.org/ofl", "w3.org/consortium", "mariadb.com/bsl")


class Rule(NamedTuple):
    label: str
    confidence: float
    keyword: str
    regex: str
    #: Its match goes where it overlaps one of another rule.
    loose: bool = False


#: label | SPDX identifier regex | keyword and regex of the name | keyword and regex of the address (empty: none)
_LICENSES = r"""
apache-2.0 | apache-2\.0 | apache licen | apache licen[sc]e,?\s+(?:version|v\.?)\s*2(?:\.0)? | apache.org/licen | apache\.org/licenses/license-2\.0
apache-1.1 | apache-1\.1 | apache | apache (?:software )?licen[sc]e,?\s+(?:version|v\.?)\s*1\.1 | apache.org/licen | apache\.org/licenses/license-1\.1
apache-1.0 | apache-1\.0 | apache | apache (?:software )?licen[sc]e,?\s+(?:version|v\.?)\s*1\.0 | apache.org/licen | apache\.org/licenses/license-1\.0
agpl-3.0 | agpl-3\.0(?:-only|-or-later|\+)? | affero general public licen | (?:gnu )?affero general public licen[sc]e,?\s+(?:version|v\.?)\s*3(?:\.0)? | gnu.org/licen | gnu\.org/licenses/agpl(?:-3\.0)?
agpl-1.0 | agpl-1\.0(?:-only|-or-later)? | affero general public licen | affero general public licen[sc]e,?\s+(?:version|v\.?)\s*1(?:\.0)? | affero.org | affero\.org/oagpl\.html
lgpl-3.0 | lgpl-3\.0(?:-only|-or-later|\+)? | lesser general public licen | (?:gnu )?lesser general public licen[sc]e,?\s+(?:version|v\.?)\s*3(?:\.0)? | gnu.org/licen | gnu\.org/licenses/lgpl-3\.0
lgpl-2.1 | lgpl-2\.1(?:-only|-or-later|\+)? | lesser general public licen | (?:gnu )?lesser general public licen[sc]e,?\s+(?:version|v\.?)\s*2\.1 | gnu.org/licen | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-2.0 | lgpl-2\.0(?:-only|-or-later|\+)? | library general public licen | (?:gnu )?library general public licen[sc]e,?\s+(?:version|v\.?)\s*2(?:\.0)? | gnu.org/licen | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
gpl-3.0 | gpl-3\.0(?:-only|-or-later|\+)? | general public licen | (?:gnu )?general public licen[sc]e,?\s+(?:version|v\.?)\s*3(?:\.0)? | gnu.org/licen | gnu\.org/licenses/gpl-3\.0
gpl-2.0 | gpl-2\.0(?:-only|-or-later|\+)? | general public licen | (?:gnu )?general public licen[sc]e,?\s+(?:version|v\.?)\s*2(?:\.0)? | gnu.org/licen | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-1.0 | gpl-1\.0(?:-only|-or-later|\+)? | general public licen | (?:gnu )?general public licen[sc]e,?\s+(?:version|v\.?)\s*1(?:\.0)? | gnu.org/licen | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
gfdl-1.3 | gfdl-1\.3(?:-only|-or-later)? | free documentation licen | free documentation licen[sc]e,?\s+(?:version|v\.?)\s*1\.3 | gnu.org/licen | gnu\.org/licenses/fdl-1\.3
gfdl-1.2 | gfdl-1\.2(?:-only|-or-later)? | free documentation licen | free documentation licen[sc]e,?\s+(?:version|v\.?)\s*1\.2 | gnu.org/licen | gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
mit-0 | mit-0 | licen | mit no attribution licen[sc]e | aws/mit-0 | github\.com/aws/mit-0
mit | mit | mit licen | (?:the )?mit licen[sc]e(?: \(mit\))? | opensource.org/licen | opensource\.org/licenses/mit
x11 | x11 | x11 licen | (?:mit/)?x11 licen[sc]e | x.org/downloads | x\.org/downloads_terms
bsd-2-clause | bsd-2-clause | bsd | (?:2|two)[- ]clause (?:simplified )?bsd licen[sc]e | opensource.org/licen | opensource\.org/licenses/bsd-2-clause
bsd-3-clause | bsd-3-clause | bsd | (?:3|three)[- ]clause (?:new |modified |revised )?bsd licen[sc]e | opensource.org/licen | opensource\.org/licenses/bsd-3-clause
bsd-4-clause | bsd-4-clause | bsd | (?:4|four)[- ]clause (?:original )?bsd licen[sc]e | directory.fsf.org/wiki/licen | directory\.fsf\.org/wiki/license:bsd-4clause
0bsd | 0bsd | bsd | (?:zero|0)[- ]clause bsd licen[sc]e | landley.net/toybox/licen | landley\.net/toybox/license
isc | isc | isc licen | isc licen[sc]e | isc.org/licen | isc\.org/licenses
mpl-2.0 | mpl-2\.0 | mozilla public licen | mozilla public licen[sc]e,?\s+(?:version|v\.?)\s*2(?:\.0)? | mozilla.org | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 | mpl-1\.1 | mozilla public licen | mozilla public licen[sc]e,?\s+(?:version|v\.?)\s*1\.1 | mozilla.org | mozilla\.org/(?:en-us/)?mpl/(?:mpl-)?1\.1
epl-2.0 | epl-2\.0 | eclipse public licen | eclipse public licen[sc]e,?\s+(?:version|v\.?)\s*2(?:\.0)? | eclipse.org/legal | eclipse\.org/legal/epl-(?:v20|2\.0)
epl-1.0 | epl-1\.0 | eclipse public licen | eclipse public licen[sc]e,?\s+(?:version|v\.?)\s*1(?:\.0)? | eclipse.org/legal | eclipse\.org/legal/epl-v10
cddl-1.0 | cddl-1\.0 | common development and distribution licen | common development and distribution licen[sc]e(?: \(cddl\))?,?\s+(?:version|v\.?)\s*1(?:\.0)? | opensource.org/licen | opensource\.org/licenses/cddl-?1
cddl-1.1 | cddl-1\.1 | common development and distribution licen | common development and distribution licen[sc]e(?: \(cddl\))?,?\s+(?:version|v\.?)\s*1\.1 | glassfish | glassfish\.[a-z.]+/public/cddl
cpl-1.0 | cpl-1\.0 | common public licen | common public licen[sc]e,?\s+(?:version|v\.?)\s*1(?:\.0)? | opensource.org/licen | opensource\.org/licenses/cpl1\.0
eupl-1.2 | eupl-1\.2 | european union public licen | european union public licen[sc]e,?\s+(?:version|v\.?)\s*1\.2 | eupl | joinup\.ec\.europa\.eu/[a-z/]*eupl
eupl-1.1 | eupl-1\.1 | european union public licen | european union public licen[sc]e,?\s+(?:version|v\.?)\s*1\.1 | eupl | ec\.europa\.eu/idabc/eupl
artistic-2.0 | artistic-2\.0 | artistic licen | artistic licen[sc]e,?\s+(?:version|v\.?)?\s*2(?:\.0)? | opensource.org/licen | opensource\.org/licenses/artistic-2\.0
artistic-1.0 | artistic-1\.0(?:-perl|-cl8)? | artistic licen | artistic licen[sc]e,?\s+(?:version|v\.?)?\s*1(?:\.0)? | opensource.org/licen | opensource\.org/licenses/artistic-1\.0
bsl-1.0 | bsl-1\.0 | boost software licen | boost software licen[sc]e(?:,?\s+(?:-\s*)?(?:version|v\.?)\s*1(?:\.0)?)? | boost.org/licen | boost\.org/license_1_0\.txt
zlib | zlib | zlib | zlib(?:/libpng)? licen[sc]e | zlib.net/zlib_licen | zlib\.net/zlib_license
libpng | libpng(?:-2\.0)? | libpng licen | libpng licen[sc]e(?: version 2)? | libpng.org | libpng\.org/[a-z/]*libpng-license
openssl | openssl | openssl licen | openssl licen[sc]e | openssl.org/source/licen | openssl\.org/source/license
postgresql | postgresql | postgresql licen | postgresql licen[sc]e | postgresql.org/about/licen | postgresql\.org/about/licen[sc]e
python-2.0 | (?:python|psf)-2\.0 | python software foundation licen | python software foundation licen[sc]e(?:,?\s+version\s*2)? | python.org | python\.org/[a-z0-9./-]*license
php-3.01 | php-3\.0?1 | php licen | php licen[sc]e(?:,?\s+version\s*3\.01)? | php.net/licen | php\.net/license/3_01
ruby | ruby | ruby licen | ruby licen[sc]e | ruby-lang | ruby-lang\.org/[a-z/]*license
ofl-1.1 | ofl-1\.1(?:-rfn|-no-rfn)? | open font licen | (?:sil )?open font licen[sc]e(?:,?\s+(?:version|v\.?)\s*1\.1)? | sil.org/ofl | scripts\.sil\.org/ofl
ms-pl | ms-pl | microsoft public licen | microsoft public licen[sc]e(?: \(ms-pl\))? | opensource.org/licen | opensource\.org/licenses/ms-pl
ms-rl | ms-rl | microsoft reciprocal licen | microsoft reciprocal licen[sc]e(?: \(ms-rl\))? | opensource.org/licen | opensource\.org/licenses/ms-rl
afl-3.0 | afl-3\.0 | academic free licen | academic free licen[sc]e(?:,?\s+(?:version|v\.?)\s*3(?:\.0)?)? | opensource.org/licen | opensource\.org/licenses/afl-3\.0
osl-3.0 | osl-3\.0 | open software licen | open software licen[sc]e(?:,?\s+(?:version|v\.?)\s*3(?:\.0)?)? | opensource.org/licen | opensource\.org/licenses/osl-3\.0
ncsa | ncsa | ncsa | (?:university of illinois/)?ncsa (?:open source )?licen[sc]e | opensource.org/licen | opensource\.org/licenses/ncsa
odbl-1.0 | odbl-1\.0 | open database licen | open database licen[sc]e(?: \(odbl\))?(?:,?\s+(?:version|v\.?)\s*1(?:\.0)?)? | opendatacommons.org/licen | opendatacommons\.org/licenses/odbl
odc-by-1.0 | odc-by-1\.0 | open data commons attribution licen | open data commons attribution licen[sc]e(?:,?\s+(?:version|v\.?)\s*1(?:\.0)?)? | opendatacommons.org/licen | opendatacommons\.org/licenses/by
pddl-1.0 | pddl-1\.0 | public domain dedication and licen | public domain dedication and licen[sc]e(?: \(pddl\))? | opendatacommons.org/licen | opendatacommons\.org/licenses/pddl
w3c | w3c | w3c | w3c (?:software )?(?:notice and )?licen[sc]e | w3.org/consortium | w3\.org/consortium/legal/[a-z0-9/-]*license
wtfpl | wtfpl | wtfpl | wtfpl(?: licen[sc]e)?(?:,?\s+version\s*2)? | wtfpl | wtfpl\.net
unlicense | unlicense | unlicense | (?:the )?unlicense | unlicense | unlicense\.org
sspl-1.0 | sspl-1\.0 | server side public licen | server side public licen[sc]e(?: \(sspl\))?(?:,?\s+(?:version|v\.?)\s*1)? | mongodb.com/licen | mongodb\.com/licensing/server-side-public-license
busl-1.1 | busl-1\.1 | business source licen | business source licen[sc]e(?:,?\s+(?:version|v\.?)\s*1\.1)? | mariadb.com/bsl | mariadb\.com/bsl11
elastic-2.0 | elastic-2\.0 | elastic licen | elastic licen[sc]e(?:,?\s+(?:version|v\.?)?\s*2(?:\.0)?)? | elastic.co/licen | elastic\.co/licensing/elastic-license
cc0-1.0 | cc0-1\.0 | cc0 | cc0(?:[- ]1\.0)?(?: universal)? | creativecommons | creativecommons\.org/publicdomain/zero/1\.0
cc-by-nc-nd | cc-by-nc-nd-[1-4]\.[05] | cc | cc[- ]by-nc-nd(?:[- ][1-4]\.[05])? | creativecommons | creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]
cc-by-nc-sa | cc-by-nc-sa-[1-4]\.[05] | cc | cc[- ]by-nc-sa(?:[- ][1-4]\.[05])? | creativecommons | creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]
cc-by-nc | cc-by-nc-[1-4]\.[05] | cc | cc[- ]by-nc(?:[- ][1-4]\.[05])? | creativecommons | creativecommons\.org/licenses/by-nc/[1-4]\.[05]
cc-by-nd | cc-by-nd-[1-4]\.[05] | cc | cc[- ]by-nd(?:[- ][1-4]\.[05])? | creativecommons | creativecommons\.org/licenses/by-nd/[1-4]\.[05]
cc-by-sa | cc-by-sa-[1-4]\.[05] | cc | cc[- ]by-sa(?:[- ][1-4]\.[05])? | creativecommons | creativecommons\.org/licenses/by-sa/[1-4]\.[05]
cc-by | cc-by-[1-4]\.[05] | cc | cc[- ]by(?:[- ][1-4]\.[05])? | creativecommons | creativecommons\.org/licenses/by/[1-4]\.[05]
"""

#: Labels and keywords of rules that take in any words.
_LOOSE = {("unknown-license", "licen"), ("unknown-license", "license agreement"), ("proprietary", "all rights reserved")}

#: label | confidence | keyword | regex; sentences of license texts and looser mentions, the surest first
_TEXTS = r"""
mit | 0.95 | permission is hereby granted, free of charge | permission is hereby granted, free of charge, to any person obtaining a copy\s+of this software
mit | 0.9 | permission notice | the above copyright notice and this permission notice\s+(?:\([a-z ]+\)\s+)?shall be included in all\s+copies
isc | 0.95 | permission to use, copy, modify, and | permission to use, copy, modify, and(?:/or)? distribute this software for any\s+purpose with or without fee
bsd | 0.9 | redistribution and use in source and binary forms | redistribution and use in source and binary forms,? with or without\s+modification
bsd-3-clause | 0.9 | permission | neither the name of [^.]{1,120} may be used to\s+endorse or promote products[^.]{0,80}without specific prior written permission
bsd-2-clause | 0.8 | redistributions of source code must retain | redistributions of source code must retain the above copyright\s+notice
bsd-2-clause | 0.8 | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright\s+notice
apache-2.0 | 0.95 | licensed under the apache license, version 2.0 | licensed under the apache license, version 2\.0 \(the ["“]license["”]\)
apache-2.0 | 0.85 | you may not use this file except in compliance with the license | you may not use this file except in compliance with the license
gpl | 0.9 | redistribute it and/or | this program is free software[:;] you can redistribute it and/or modify\s+it under the terms of the gnu general public license
lgpl | 0.9 | redistribute it and/or | this library is free software[:;] you can redistribute it and/or\s+modify it under the terms of the gnu (?:lesser|library) general public\s+license
gpl | 0.7 | of the licen | either version [123](?:\.\d)? of the license, or\s+(?:\(at your option\)\s+)?any later version
gpl | 0.7 | gpl | gplv?[- ]?[123](?:\.0)?(?: or later|\+)?
lgpl | 0.7 | lgpl | lgplv?[- ]?[23](?:\.[01])?(?: or later|\+)?
agpl | 0.7 | agpl | agplv?[- ]?3(?:\.0)?(?: or later|\+)?
zlib | 0.9 | permission is granted to anyone to use this software | permission is granted to anyone to use this software for any purpose,\s+including commercial applications
bsl-1.0 | 0.9 | permission is hereby granted | permission is hereby granted, free of charge, to any person or organization\s+obtaining a copy
ofl-1.1 | 0.9 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining\s+a copy of the font software
unlicense | 0.95 | released into the public domain | this is free and unencumbered software released into the public domain
public-domain | 0.8 | public domain | (?:dedicated|released|placed|put) (?:in|in?to) the public domain
public-domain | 0.6 | public domain | (?:is|are|work|works) (?:now )?in the public domain
wtfpl | 0.95 | licen | do what the fuck you want to public licen[sc]e
mpl-2.0 | 0.95 | licen | this source code form is subject to the terms of the mozilla public\s+license
cc-by-sa | 0.85 | creative commons attribution | creative commons attribution-share ?alike(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc-sa | 0.85 | creative commons attribution | creative commons attribution-non-?commercial-share ?alike(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc-nd | 0.85 | creative commons attribution | creative commons attribution-non-?commercial-no-?deriv(?:ative)?s?(?: works)?(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nc | 0.85 | creative commons attribution | creative commons attribution-non-?commercial(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by-nd | 0.85 | creative commons attribution | creative commons attribution-no-?deriv(?:ative)?s?(?: works)?(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[sc]e)?
cc-by | 0.85 | creative commons attribution | creative commons attribution(?: [1-4]\.[05])?(?: international| unported| generic)?(?: licen[sc]e)?
creative-commons | 0.6 | creative commons licen | creative commons licen[sc]e
copyleft | 0.5 | copyleft | copyleft
proprietary | 0.6 | all rights reserved | (?:copyright|©|\(c\))[^\n]{0,80}?all rights reserved
proprietary | 0.7 | licen | (?:proprietary|commercial|end[- ]user|evaluation) licen[sc]e(?: agreement)?
no-warranty | 0.4 | warrant | without warrant(?:y|ies)(?: or conditions)? of any kind,? (?:either )?express(?:ed)? or implied
dual-license | 0.5 | licen | (?:dual|double|multi)[- ]licen[sc]ed
gfdl | 0.7 | free documentation licen | (?:gnu )?free documentation licen[sc]e
agpl | 0.7 | affero general public licen | (?:gnu )?affero general public licen[sc]e
lgpl | 0.7 | general public licen | (?:gnu )?(?:lesser|library) general public licen[sc]e
gpl | 0.65 | general public licen | (?:gnu )?general public licen[sc]e
apache | 0.65 | apache licen | apache licen[sc]e
mpl | 0.65 | mozilla public licen | mozilla public licen[sc]e
epl | 0.65 | eclipse public licen | eclipse public licen[sc]e
bsd | 0.65 | bsd licen | bsd licen[sc]e
artistic | 0.65 | artistic licen | artistic licen[sc]e
unknown-license | 0.3 | licen | (?:licensed|licenced|released|distributed|published) under (?:the )?(?:terms of )?[^\n.,;]{1,60}?licen[sc]e
unknown-license | 0.2 | license agreement | license agreement
"""

_GRANT = r"(?:licen[sc]ed|released|distributed|available|published|provided|offered|governed) (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"


def _root_or(keyword: str, fallback: str) -> str:
    return keyword if any(r in keyword for r in ROOTS) else fallback


def rules() -> list[Rule]:
    """All rules in order of priority: identifiers, grants, addresses, names, then sentences and loose mentions."""
    table = [[x.strip() for x in line.split(" | ")] for line in _LICENSES.strip().splitlines()]
    grants, ids, places, names = [], [], [], []
    for label, spdx, keyword, name, place_keyword, place in table:
        root = _root_or(keyword, "cc by" if label.startswith("cc-") else "licen")
        ids.append(Rule(label, 1.0, "spdx-license-identifier", rf"spdx-license-identifier:\s*(?:\()?{spdx}(?![a-z0-9.-])"))
        # CC names are written with a space or a hyphen, so their grants have one rule for each.
        for root, name in [(root, name)] if not label.startswith("cc-") else [("cc by", name.replace("[- ]by", " by")), ("cc-by", name.replace("[- ]by", "-by"))]:
            grants.append(Rule(label, 0.95, root, rf"{_GRANT}{name}"))
            names.append(Rule(label, 0.75, root, rf"(?<![a-z0-9]){name}(?![a-z0-9])"))
        places.append(Rule(label, 0.9, place_keyword, place))
    texts = [Rule(a, float(b), c, d, (a, c) in _LOOSE) for a, b, c, d in ([x.strip() for x in line.split(" | ")] for line in _TEXTS.strip().splitlines())]
    return [*ids, *grants, *places, *texts[:14], *names, *texts[14:]]
