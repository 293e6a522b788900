"""Signature rules for license texts: fixed data, written by hand.

A line is ``label | keyword | pattern``. Patterns are matched against the words of a text in lower case, one blank between
two words (``cc-by 4.0`` reads ``cc by 4 0``), at word limits. A keyword is a string without which the pattern can't match;
it gates the pattern. Within a section all rules share a priority: the higher, the more a rule says by itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: re.Pattern[str]
    priority: int
    weight: float


#: Machine-readable tags.
TAGS = """
0bsd | spdx | spdx license identifier 0bsd
afl-3.0 | spdx | spdx license identifier afl 3 0
agpl-3.0 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
apache-1.1 | spdx | spdx license identifier apache 1 1
apache-2.0 | spdx | spdx license identifier apache 2 0
artistic-2.0 | spdx | spdx license identifier artistic 2 0
bsd-2-clause | spdx | spdx license identifier bsd 2 clause(?: patent)?
bsd-3-clause | spdx | spdx license identifier bsd 3 clause(?: clear)?
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
bsl-1.0 | spdx | spdx license identifier bsl 1 0
busl-1.1 | spdx | spdx license identifier busl 1 1
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by | spdx | spdx license identifier cc by [1-4] [0-9]
cc-by-nc | spdx | spdx license identifier cc by nc [1-4] [0-9]
cc-by-nc-nd | spdx | spdx license identifier cc by nc nd [1-4] [0-9]
cc-by-nc-sa | spdx | spdx license identifier cc by nc sa [1-4] [0-9]
cc-by-nd | spdx | spdx license identifier cc by nd [1-4] [0-9]
cc-by-sa | spdx | spdx license identifier cc by sa [1-4] [0-9]
cddl-1.0 | spdx | spdx license identifier cddl 1 [01]
ecl-2.0 | spdx | spdx license identifier ecl 2 0
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
eupl-1.2 | spdx | spdx license identifier eupl 1 [0-2]
gfdl | spdx | spdx license identifier gfdl 1 [1-3](?: only| or later)?
gpl-2.0 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
isc | spdx | spdx license identifier isc
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
lppl | spdx | spdx license identifier lppl 1 [0-3][a-c]?
mit | spdx | spdx license identifier mit(?: 0)?
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | spdx | spdx license identifier mpl 2 0
ms-pl | spdx | spdx license identifier ms pl
ncsa | spdx | spdx license identifier ncsa
odbl | spdx | spdx license identifier odbl 1 0
ofl-1.1 | spdx | spdx license identifier ofl 1 [01]
postgresql | spdx | spdx license identifier postgresql
psf-2.0 | spdx | spdx license identifier (?:psf|python) 2 0
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
zlib | spdx | spdx license identifier zlib
"""

#: Addresses of license texts.
ADDRESSES = """
apache-2.0 | apache org | (?:www )?apache org licenses license 2 0
apache-1.1 | apache org | (?:www )?apache org licenses license 1 1
artistic-2.0 | artistic | opensource org licenses artistic license 2 0
bsd-2-clause | bsd | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | opensource org licenses bsd 3 clause
bsl-1.0 | boost | boost org license 1 0 txt
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
cc-by | creativecommons | creativecommons org licenses by [1-4] [0-9]
cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [0-9]
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [0-9]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [0-9]
cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [0-9]
cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [0-9]
epl-1.0 | eclipse org | eclipse org legal epl v10
epl-2.0 | eclipse org | eclipse org legal epl (?:2 0|v20)
agpl-3.0 | gnu org | gnu org licenses agpl(?: 3 0)?
gfdl | gnu org | gnu org (?:licenses|copyleft) fdl
gpl-2.0 | gnu org | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | gnu org | gnu org licenses gpl 3 0
gpl | gnu org | gnu org (?:licenses|copyleft) gpl
lgpl-2.1 | gnu org | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | gnu org | gnu org licenses lgpl 3 0
lgpl | gnu org | gnu org (?:licenses|copyleft) (?:lgpl|lesser)
isc | isc | opensource org licenses isc(?: license)?
mit | mit | opensource org licenses mit(?: license)?
mpl-1.1 | mozilla org | mozilla org mpl(?: 1 1| mpl 1 1)?
mpl-2.0 | mozilla org | mozilla org (?:en us )?mpl 2 0
ms-pl | ms pl | opensource org licenses ms pl
odbl | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
odc-by | opendatacommons | opendatacommons org licenses by(?: 1 0)?
pddl | opendatacommons | opendatacommons org licenses pddl(?: 1 0)?
ofl-1.1 | sil | scripts sil org ofl
unlicense | unlicense | unlicense org
wtfpl | wtfpl | (?:www )?wtfpl net
zlib | zlib | zlib net zlib license
"""

#: Sentences of grants and notices.
NOTICES = """
apache-2.0 | apache | licensed under the apache license version 2 0
apache-2.0 | apache | under the terms of the apache license version 2 0
apache-2.0 | apache | apache license version 2 0 january 2004
apache-2.0 | apache | released under (?:the )?apache(?: license)? (?:version |v )?2(?: 0)?
apache-1.1 | apache | the apache software license version 1 1
apache-2.0 | as is | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
agpl-3.0 | affero | gnu affero general public license(?: as published by the free software foundation)?(?: either)?(?: version 3)?
agpl-3.0 | agpl | licensed under (?:the )?(?:gnu )?agpl(?: ?v?3)?
gpl-2.0 | general public license | gnu general public license(?: as published by the free software foundation)?(?: either)? version 2
gpl-3.0 | general public license | gnu general public license(?: as published by the free software foundation)?(?: either)? version 3
gpl-1.0 | general public license | gnu general public license(?: as published by the free software foundation)?(?: either)? version 1
gpl-2.0 | gpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl ?v?2(?: 0)?
gpl-3.0 | gpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl ?v?3(?: 0)?
gpl | general public license | redistribute it and or modify it under the terms of the gnu general public license
gpl | general public license | you should have received a copy of the gnu general public license
gpl | general public license | licensed under the (?:terms of the )?(?:gnu )?general public license
lgpl-2.1 | lesser general public | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1
lgpl-3.0 | lesser general public | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3
lgpl-2.0 | library general public | gnu library general public license(?: as published by the free software foundation)?(?: either)?(?: version 2)?
lgpl | lesser general public | you should have received a copy of the gnu lesser general public license
lgpl | lgpl | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl
gfdl | free documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | free documentation | gnu free documentation license(?: version 1 [1-3])?
mit | mit license | (?:released|licensed|distributed|available) under the (?:terms of the )?mit license
mit | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit | without restriction | to deal in the software without restriction including without limitation
mit-0 | no attribution | mit no attribution(?: license)?
x11 | x11 | (?:licensed|released) under the x11 license
expat | expat | (?:licensed|released) under the expat license
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | binary form | redistributions in binary form must reproduce the above copyright notice
bsd-2-clause | source code must | redistributions of source code must retain the above copyright notice
bsd-3-clause | endorse or promote | neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
bsd-2-clause | bsd | (?:simplified|2 clause|two clause) bsd license
bsd-2-clause | bsd | bsd (?:2 clause|two clause) license
bsd-3-clause | bsd | (?:new|revised|modified|3 clause|three clause) bsd license
bsd-3-clause | bsd | bsd (?:3 clause|three clause) license
bsd-4-clause | bsd | (?:original|4 clause|four clause) bsd license
bsd | bsd | (?:released|licensed|distributed|available) under (?:the |a )?bsd(?: style)? license
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | isc | (?:released|licensed|distributed) under the isc license
zlib | altered source | altered source versions must be plainly marked as such
zlib | zlib | (?:released|licensed|distributed) under the zlib(?: libpng)? license
zlib | misrepresented | the origin of this software must not be misrepresented
mpl-1.1 | mozilla public | subject to the mozilla public license version 1 1
mpl-2.0 | mozilla public | subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-2.0 | mozilla public | mozilla public license (?:version |v )?2 0
mpl | mozilla public | (?:released|licensed|distributed) under the mozilla public license
epl-1.0 | eclipse public | eclipse public license (?:version |v )?1 0
epl-2.0 | eclipse public | eclipse public license (?:version |v )?2 0
epl | eclipse public | (?:released|licensed|made available) under the (?:terms of the )?eclipse public license
edl-1.0 | eclipse distribution | eclipse distribution license (?:version |v )?1 0
cddl-1.0 | common development | common development and distribution license(?: version 1 [01])?
cpl-1.0 | common public | common public license(?: version| v)? 1 0
ipl-1.0 | ibm public | ibm public license(?: version)? 1 0
eupl-1.2 | european union public | european union public licen[cs]e(?: v)?(?: 1 [0-2])?
eupl-1.2 | eupl | licensed under the eupl(?: v)?(?: 1 [0-2])?
bsl-1.0 | boost software | boost software license(?: version)? 1 0
busl-1.1 | business source | business source license(?: version)? 1 1
elastic-2.0 | elastic license | elastic license(?: version)? 2 0
sspl-1.0 | server side public | server side public license(?: version 1)?
artistic-2.0 | artistic | (?:the )?artistic license(?: version)? 2 0
artistic-1.0 | artistic | (?:the )?artistic license(?: version)? 1 0
artistic | same terms as perl | (?:under|on) the same terms as perl itself
afl-3.0 | academic free | academic free license(?: version)? 3 0
osl-3.0 | open software | open software license(?: version)? 3 0
ecl-2.0 | educational community | educational community license(?: version)? 2 0
ncsa | university of illinois | university of illinois ncsa open source license
postgresql | postgresql | (?:released|licensed) under the postgresql licen[cs]e
psf-2.0 | python software foundation | python software foundation license(?: version 2)?
php-3.01 | php license | (?:the )?php license(?: version)? 3 0[01]?
ruby | ruby | (?:under|on) the same terms as ruby
ms-pl | microsoft public | microsoft public license(?: ms pl)?
ms-rl | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
unlicense | public domain | this is free and unencumbered software released into the public domain
unlicense | unlicense | (?:released|licensed) under the unlicense
wtfpl | what the fuck | do what the fuck you want to public license
0bsd | zero clause | (?:bsd zero clause|zero clause bsd) license
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
ofl-1.1 | open font | sil open font license(?: version)?(?: 1 [01])?
lppl | latex project | latex project public license
vim | vim license | (?:released|licensed) under the vim license
curl | curl license | (?:released|licensed) under the curl license
openssl | openssl | this product includes software developed by the openssl project
odbl | open database | open database license(?: odbl)?(?: v)?(?: 1 0)?
odc-by | open data commons | open data commons attribution license(?: v)?(?: 1 0)?
pddl | open data commons | open data commons public domain dedication and licen[cs]e
ogl-uk | open government | open government licen[cs]e(?: v)?(?: [1-3] 0)?
cdla-permissive | community data | community data license agreement permissive
cdla-sharing | community data | community data license agreement sharing
openrail | rail | (?:creativeml |bigscience )?open ?rail(?: [ms])*(?: license)?
etalab | etalab | (?:licence ouverte|open licence) etalab(?: 2 0)?
dl-de | datenlizenz | datenlizenz deutschland(?: namensnennung)?(?: (?:version )?2 0)?
"""

#: Names of creative-commons licenses, and of others, wherever they stand.
NAMES = """
cc-by-nc-nd | cc by nc nd | cc by nc nd(?: [1-4] [0-9])?
cc-by-nc-sa | cc by nc sa | cc by nc sa(?: [1-4] [0-9])?
cc-by-nc | cc by nc | cc by nc(?: [1-4] [0-9])?
cc-by-nd | cc by nd | cc by nd(?: [1-4] [0-9])?
cc-by-sa | cc by sa | cc by sa(?: [1-4] [0-9])?
cc-by | cc by | cc by(?: [1-4] [0-9])?
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | cc zero | cc zero(?: 1 0)?
cc-by-nc-nd | noncommercial | attribution noncommercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [0-9])?
cc-by-nc-nd | non commercial | attribution non commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [0-9])?
cc-by-nc-sa | noncommercial | attribution noncommercial share ?alike(?: [1-4] [0-9])?
cc-by-nc-sa | non commercial | attribution non commercial share ?alike(?: [1-4] [0-9])?
cc-by-nc | noncommercial | creative commons attribution noncommercial(?: [1-4] [0-9])?
cc-by-nc | non commercial | creative commons attribution non commercial(?: [1-4] [0-9])?
cc-by-nd | deriv | creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [0-9])?
cc-by-sa | alike | creative commons attribution share ?alike(?: [1-4] [0-9])?
cc-by | creative commons | creative commons attribution(?: [1-4] [0-9])?
cc-sampling | creative commons | creative commons sampling(?: plus)?(?: 1 0)?
cc | creative commons | (?:under|with) a creative commons licen[cs]e
mit | mit license | mit license
mit | mit licence | mit licence
apache-2.0 | apache | apache 2(?: 0)?(?: license)?
apache | apache license | apache license
apache | apache software license | apache software license
gpl-2.0 | gpl | gpl ?v?2(?: 0)?
gpl-3.0 | gpl | gpl ?v?3(?: 0)?
gpl-2.0 | gnu gpl | gnu gpl version 2
gpl-3.0 | gnu gpl | gnu gpl version 3
gpl | general public license | (?:gnu )?general public license
gpl | gnu gpl | gnu gpl
lgpl-2.1 | lgpl | lgpl ?v?2 1
lgpl-3.0 | lgpl | lgpl ?v?3(?: 0)?
lgpl | lesser general public | (?:gnu )?lesser general public license
agpl-3.0 | agpl | agpl ?v?3(?: 0)?
agpl | affero | affero general public license
bsd | bsd license | bsd license
bsd | bsd licence | bsd licence
mpl | mozilla public | mozilla public license
mpl-2.0 | mpl | mpl ?v?2(?: 0)?
epl | eclipse public | eclipse public license
isc | isc license | isc license
zlib | zlib license | zlib license
boost | boost software | boost software license
eupl | eupl | eupl(?: 1 [0-2])?
artistic | artistic license | artistic license
unlicense | unlicense | the unlicense
public-domain | public domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
public-domain | public domain | (?:is|are) (?:in the )?public domain
public-domain | gemeinfrei | gemeinfrei(?:e|es)?
public-domain | domaine public | dans le domaine public
public-domain | dominio | (?:de|en el) dominio p[uú]blico
"""

#: Reservations, which say what is not allowed.
RESERVATIONS = """
reserved | all rights reserved | all rights reserved
reserved | rights reserved | (?:some|certain|no) rights reserved
reserved | alle rechte | alle rechte vorbehalten
reserved | tous droits | tous droits r[eé]serv[eé]s
reserved | derechos reservados | todos los derechos reservados
reserved | diritti riservati | tutti i diritti riservati
reserved | direitos reservados | todos os direitos reservados
proprietary | proprietary | (?:this (?:software|document|work) is )?(?:confidential and )?proprietary(?: and confidential)
proprietary | no part of | no part of this (?:publication|work|book|document) may be reproduced
proprietary | prior written | without (?:the )?(?:express )?prior written (?:permission|consent)
proprietary | not be copied | may not be copied (?:reproduced )?(?:or )?(?:distributed|redistributed)
proprietary | unauthori | (?:unauthorized|unauthorised) (?:use|copying|reproduction|duplication)(?: or distribution)?
proprietary | end user licen | end user licen[cs]e agreement
noncommercial | commercial | (?:for )?non ?commercial (?:use|purposes) only
noncommercial | personal use | for personal use only
noncommercial | commercial use | (?:no|not for) commercial use
research-only | research | for research(?: and academic)? (?:use|purposes) only
research-only | academic | for academic(?: and research)? (?:use|purposes) only
evaluation-only | evaluation | for evaluation (?:use|purposes) only
copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
"""

#: Sections with their priority and how sure a detection is.
SECTIONS = ((TAGS, 5, 1.0), (ADDRESSES, 4, 0.95), (NOTICES, 3, 0.9), (NAMES, 2, 0.7), (RESERVATIONS, 1, 0.6))


def _read(section: str, priority: int, weight: float) -> list[Rule]:
    rules = []
    for line in section.strip().splitlines():
        label, keyword, pattern = line.split(" | ")
        rules.append(Rule(label, keyword, re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])"), priority, weight))
    return rules


#: In order: the first of equal detections stays.
RULES = [rule for section in SECTIONS for rule in _read(*section)]
