"""Signature rules of licences, hand-written, in order of priority: earlier rules win over what they contain.

A line is `label | keyword | regex`.  The keyword is in every match, in lower case, and gates the rule.  In the regex a
space stands for a run of characters that are neither letters nor digits; matching is on text with A-Z lower-cased.
The sections differ in how much a match says: a tag names the licence, a notice grants it, a clause is a part of its
text, a link points to it, a name mentions it.
"""

from __future__ import annotations

TAGS = """
apache-1.0 | spdx | spdx license identifier apache 1 0
apache-1.1 | spdx | spdx license identifier apache 1 1
apache-2.0 | spdx | spdx license identifier apache 2 0( with llvm exception)?
mit-0 | spdx | spdx license identifier mit 0
mit | spdx | spdx license identifier mit
x11 | spdx | spdx license identifier x11
0bsd | spdx | spdx license identifier 0bsd
bsd-1-clause | spdx | spdx license identifier bsd 1 clause
bsd-2-clause | spdx | spdx license identifier bsd 2 clause( patent| views)?
bsd-3-clause-clear | spdx | spdx license identifier bsd 3 clause clear
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause( uc)?
isc | spdx | spdx license identifier isc
agpl-1.0 | spdx | spdx license identifier agpl 1 0( only| or later)?
agpl-3.0 | spdx | spdx license identifier agpl 3 0( only| or later)?
lgpl-2.0 | spdx | spdx license identifier lgpl 2 0( only| or later)?
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1( only| or later)?
lgpl-3.0 | spdx | spdx license identifier lgpl 3 0( only| or later)?
gpl-1.0 | spdx | spdx license identifier gpl 1 0( only| or later)?
gpl-2.0 | spdx | spdx license identifier gpl 2 0( only| or later)?( with classpath exception 2 0)?
gpl-3.0 | spdx | spdx license identifier gpl 3 0( only| or later)?
gfdl-1.1 | spdx | spdx license identifier gfdl 1 1( only| or later)?
gfdl-1.2 | spdx | spdx license identifier gfdl 1 2( only| or later)?
gfdl-1.3 | spdx | spdx license identifier gfdl 1 3( only| or later)?
mpl-1.0 | spdx | spdx license identifier mpl 1 0
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | spdx | spdx license identifier mpl 2 0
npl-1.1 | spdx | spdx license identifier npl 1 1
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
cpl-1.0 | spdx | spdx license identifier cpl 1 0
ipl-1.0 | spdx | spdx license identifier ipl 1 0
cddl-1.0 | spdx | spdx license identifier cddl 1 0
cddl-1.1 | spdx | spdx license identifier cddl 1 1
cc0-1.0 | spdx | spdx license identifier cc0 1 0
cc-by-nc-nd | spdx | spdx license identifier cc by nc nd [1-4] [05]
cc-by-nc-sa | spdx | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc | spdx | spdx license identifier cc by nc [1-4] [05]
cc-by-nd | spdx | spdx license identifier cc by nd [1-4] [05]
cc-by-sa | spdx | spdx license identifier cc by sa [1-4] [05]
cc-by | spdx | spdx license identifier cc by [1-4] [05]
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
zlib | spdx | spdx license identifier zlib
libpng | spdx | spdx license identifier libpng( 2 0)?
bsl-1.0 | spdx | spdx license identifier bsl 1 0
busl-1.1 | spdx | spdx license identifier busl 1 1
sspl-1.0 | spdx | spdx license identifier sspl 1 0
elastic-2.0 | spdx | spdx license identifier elastic 2 0
artistic-1.0 | spdx | spdx license identifier artistic 1 0( perl| cl8)?
artistic-2.0 | spdx | spdx license identifier artistic 2 0
eupl-1.1 | spdx | spdx license identifier eupl 1 1
eupl-1.2 | spdx | spdx license identifier eupl 1 2
osl-3.0 | spdx | spdx license identifier osl 3 0
afl-3.0 | spdx | spdx license identifier afl 3 0
ms-pl | spdx | spdx license identifier ms pl
ms-rl | spdx | spdx license identifier ms rl
ncsa | spdx | spdx license identifier ncsa
postgresql | spdx | spdx license identifier postgresql
python-2.0 | spdx | spdx license identifier (python|psf) 2 0
php-3.0 | spdx | spdx license identifier php 3 0
php-3.01 | spdx | spdx license identifier php 3 01
ruby | spdx | spdx license identifier ruby
openssl | spdx | spdx license identifier openssl
w3c | spdx | spdx license identifier w3c
ofl-1.1 | spdx | spdx license identifier ofl 1 1
odbl-1.0 | spdx | spdx license identifier odbl 1 0
odc-by-1.0 | spdx | spdx license identifier odc by 1 0
pddl-1.0 | spdx | spdx license identifier pddl 1 0
cecill-b | spdx | spdx license identifier cecill b
cecill-c | spdx | spdx license identifier cecill c
cecill-2.1 | spdx | spdx license identifier cecill 2 1
ecl-2.0 | spdx | spdx license identifier ecl 2 0
upl-1.0 | spdx | spdx license identifier upl 1 0
apsl-2.0 | spdx | spdx license identifier apsl 2 0
lppl-1.3c | spdx | spdx license identifier lppl 1 3[ac]
qpl-1.0 | spdx | spdx license identifier qpl 1 0
sleepycat | spdx | spdx license identifier sleepycat
vim | spdx | spdx license identifier vim
zpl-2.1 | spdx | spdx license identifier zpl 2 [01]
curl | spdx | spdx license identifier curl
ijg | spdx | spdx license identifier ijg
tcl | spdx | spdx license identifier tcl
icu | spdx | spdx license identifier icu
unicode | spdx | spdx license identifier unicode (dfs 201[56]|3 0|tou)
bzip2 | spdx | spdx license identifier bzip2 1 0 [56]
mulan-psl-2.0 | spdx | spdx license identifier mulanpsl 2 0
blueoak-1.0.0 | spdx | spdx license identifier blueoak 1 0 0
"""

NOTICES = """
apache-2.0 | apache | (licensed|released|distributed|available|made available) under( the)? apache( software)? license( version| v)? ?2( 0)?
apache-1.1 | apache | (licensed|released|distributed) under( the)? apache software license( version| v)? ?1 1
apache-2.0 | apache | you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0
apache | apache | (licensed|released|distributed) under( the terms of)?( the)? apache( software)? license
mit | licen | (licensed|released|distributed|available|published|provided) under( the terms of)?( the)? mit( x11| expat)? licen[cs]e
mit | licen | mit licensed
bsd-2-clause | bsd | (licensed|released|distributed) under( the terms of)?( the)?( simplified)? bsd 2 clause
bsd-2-clause | simplified bsd | (licensed|released|distributed) under( the)? simplified bsd
bsd-3-clause | bsd | (licensed|released|distributed) under( the terms of)?( the)?( new| modified| revised)? bsd 3 clause
bsd-3-clause | bsd | (licensed|released|distributed) under( the)? (new|modified|revised) bsd licen[cs]e
bsd | bsd | (licensed|released|distributed|governed) (under|by)( the terms of)?( a| the)? bsd( style)? licen[cs]e
isc | licen | (licensed|released|distributed) under( the terms of)?( the)? isc licen[cs]e
agpl-3.0 | affero | (under|by) the terms of the gnu affero general public license as published by the free software foundation (either )?version 3
agpl-3.0 | affero | (licensed|released|distributed) under( the)? (gnu )?affero general public license( version| v)? ?3
agpl | affero | (licensed|released|distributed) under( the terms of)?( the)? (gnu )?affero general public license
agpl-3.0 | agpl | (licensed|released|distributed) under( the)?( gnu)? agpl ?v?3( 0)?
lgpl-2.1 | lesser | (under|by) the terms of the gnu lesser general public license as published by the free software foundation (either )?version 2 1
lgpl-3.0 | lesser | (under|by) the terms of the gnu lesser general public license as published by the free software foundation (either )?version 3
lgpl-2.0 | library | (under|by) the terms of the gnu library general public license as published by the free software foundation (either )?version 2
lgpl-2.1 | lgpl | (licensed|released|distributed) under( the)?( gnu)? lgpl ?v?2 1
lgpl-3.0 | lgpl | (licensed|released|distributed) under( the)?( gnu)? lgpl ?v?3
lgpl | lesser | (licensed|released|distributed) under( the terms of)?( the)?( gnu)? (lesser|library) general public license
lgpl | lgpl | (licensed|released|distributed) under( the)?( gnu)? lgpl
gpl-2.0 | general public | (under|by) the terms of the gnu general public license as published by the free software foundation (either )?version 2
gpl-3.0 | general public | (under|by) the terms of the gnu general public license as published by the free software foundation (either )?version 3
gpl-2.0 | general public | (licensed|released|distributed) under( the)?( gnu)? general public license( version| v)? ?2
gpl-3.0 | general public | (licensed|released|distributed) under( the)?( gnu)? general public license( version| v)? ?3
gpl-2.0 | gpl | (licensed|released|distributed) under( the)?( gnu)? gpl ?v?2
gpl-3.0 | gpl | (licensed|released|distributed) under( the)?( gnu)? gpl ?v?3
gpl-2.0 | general public | under the gnu general public license v2( or later)?
gpl-3.0 | general public | under the gnu general public license v3( or later)?
gpl | general public | (licensed|released|distributed|covered|redistribute it) (under|by)?( the terms of)?( the)?( gnu)? general public license
gpl | gpl | (licensed|released|distributed) under( the)?( gnu)? gpl
gfdl | documentation | (under|by) the terms of the gnu free documentation license
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mozilla | (licensed|released|distributed) under( the)? mozilla public license( version| v)? ?2
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl | mozilla | (licensed|released|distributed|subject) (under|to)( the terms of)?( the)? mozilla public license
epl-2.0 | eclipse | under the terms of the eclipse public license (v |version )?2 0
epl-1.0 | eclipse | under the terms of the eclipse public license (v |version )?1 0
epl | eclipse | (licensed|released|distributed|available) under( the terms of)?( the)? eclipse public license
cddl-1.0 | common development | subject to the terms of the common development and distribution license( version 1 0)?
cc0-1.0 | cc0 | (licensed|released|dedicated|available) (under|to|with)( the)?( creative commons)? cc0
cc-by-nc-nd | creative commons | under( a| the)? creative commons attribution non ?commercial no ?deriv(s|atives|ative works)?
cc-by-nc-sa | creative commons | under( a| the)? creative commons attribution non ?commercial share ?alike
cc-by-nc | creative commons | under( a| the)? creative commons attribution non ?commercial
cc-by-nd | creative commons | under( a| the)? creative commons attribution no ?deriv(s|atives|ative works)?
cc-by-sa | creative commons | under( a| the)? creative commons attribution share ?alike
cc-by | creative commons | under( a| the)? creative commons attribution
cc-by-nc-nd | cc | (licensed|released|available|shared|distributed) under( a| the)? cc by nc nd
cc-by-nc-sa | cc | (licensed|released|available|shared|distributed) under( a| the)? cc by nc sa
cc-by-nc | cc | (licensed|released|available|shared|distributed) under( a| the)? cc by nc
cc-by-nd | cc | (licensed|released|available|shared|distributed) under( a| the)? cc by nd
cc-by-sa | cc | (licensed|released|available|shared|distributed) under( a| the)? cc by sa
cc-by | cc | (licensed|released|available|shared|distributed) under( a| the)? cc by
creative-commons | creative commons | (licensed|released|available|shared) under( a| the)? creative commons
public-domain | public domain | (placed|released|dedicated|is|donated) (in|into|to) the public domain
public-domain | public domain | this (work|file|document|text|software) is (in )?(the )?public domain
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | do what the fuck | do what the fuck you want to public license
zlib | zlib | (licensed|released|distributed) under( the)? zlib( libpng)? licen[cs]e
bsl-1.0 | boost | distributed under the boost software license version 1 0
artistic-2.0 | artistic | under( the terms of)?( the)? artistic license( version)? 2 0
artistic | artistic | under( the terms of)?( the)?( perl)? artistic license
python-2.0 | python | (licensed|released|distributed) under( the)? python software foundation license
ofl-1.1 | open font | this font software is licensed under the sil open font license version 1 1
odbl-1.0 | open database | made available under the open database license
odbl-1.0 | open data commons | available under the open data commons open database license
pddl-1.0 | public domain dedication | available under the public domain dedication and license
eupl-1.2 | european union | licensed under the eupl version 1 2
eupl | european union | licensed under( the)? european union public licen[cs]e
busl-1.1 | business source | (use of this software is governed by|licensed under)( the)? business source license
sspl-1.0 | server side | under the terms of the server side public license
elastic-2.0 | elastic | (licensed|released) under( the)? elastic license( 2 0)?
ms-pl | microsoft | (licensed|released) under( the)? microsoft public license
ms-rl | microsoft | (licensed|released) under( the)? microsoft reciprocal license
ncsa | illinois | under the university of illinois( ncsa)? open source license
php-3.01 | php | subject to version 3 01 of the php license
php-3.0 | php | subject to version 3 0 of the php license
zpl-2.1 | zope | subject to the provisions of the zope public license version 2 [01]
w3c | w3c | under( the)? w3c software( notice)?( and)?( document)? license
lppl-1.3c | latex | under the conditions of the latex project public license
cecill-2.1 | cecill | governed by the cecill license under french law
cecill-b | cecill | governed by the cecill b license under french law
cecill-c | cecill | governed by the cecill c license under french law
proprietary | proprietary | (confidential and proprietary|proprietary and confidential|proprietary information of)
proprietary | permission | no part of this (publication|work|document|book) may be reproduced
proprietary | permission | (may not be (copied|reproduced|redistributed)|reproduction prohibited) without( prior| written| express)* permission
same-terms-as-perl | perl | under the same terms as perl itself
custom-terms | terms | (use|usage) (is|of this (site|work|document) is) subject to (the|our) terms
"""

CLAUSES = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
postgresql | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment
bsd-3-clause | endorse or promote | neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products
bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions | redistributions (of source code|in binary form) must (retain|reproduce) the above copyright notice
apache-2.0 | perpetual | hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0 | unless required by applicable | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl | warranty | this program is distributed in the hope that it will be useful but without any warranty
gpl | free software | this program is free software you can redistribute it and or modify it
lgpl | free software | this library is free software you can redistribute it and or modify it
gpl | copyleft | the licenses for most software( and other practical works)? are designed to take away your freedom to share and change
gpl | received a copy | you should have received a copy of the gnu general public license along with this program
lgpl | received a copy | you should have received a copy of the gnu lesser general public license along with this library
agpl | received a copy | you should have received a copy of the gnu affero general public license along with this program
gfdl | invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl | covered software | covered software is provided under this license on an as is basis
epl | contributor | each contributor hereby grants recipient a non exclusive worldwide royalty free
unlicense | anyone is free | anyone is free to copy modify publish use compile sell or distribute this software
cc0-1.0 | waives | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
cc-by | attribution | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-nc | commercial | you may not use the material for commercial purposes
cc-by-nd | remix | if you remix transform or build upon the material you may not distribute the modified material
cc-by-sa | remix | if you remix transform or build upon the material you must distribute your contributions under the same license
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented
zlib | misrepresented | the origin of this software must not be misrepresented
bsl-1.0 | executable object | unless such copies or derivative works are solely in the form of machine executable object code
openssl | openssl | this product includes software developed by the openssl project
wtfpl | everyone is permitted | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
ofl-1.1 | reserved font | with reserved font name
artistic | standard version | you may make and give away verbatim copies of the source form of the standard version
ijg | independent jpeg | this software is based in part on the work of the independent jpeg group
python-2.0 | psf | psf hereby grants licensee a nonexclusive royalty free world wide license
ncsa | permission is hereby granted | deal with the software without restriction including without limitation the rights to use
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used
proprietary | reverse engineer | you (may|shall) not (reverse engineer|decompile|disassemble)
proprietary | non transferable | grants you a( limited| personal| revocable)* non exclusive( and)? non transferable licen[cs]e
"""

LINKS = """
apache-2.0 | apache.org | apache org licenses license 2 0
apache-1.1 | apache.org | apache org licenses license 1 1
mit | opensource.org | opensource org licenses? mit
bsd-2-clause | opensource.org | opensource org licenses? bsd 2 clause
bsd-3-clause | opensource.org | opensource org licenses? bsd 3 clause
isc | opensource.org | opensource org licenses? isc
gpl-2.0 | gnu.org | gnu org licenses( old licenses)? gpl 2 0
gpl-3.0 | gnu.org | gnu org licenses gpl 3 0
lgpl-2.1 | gnu.org | gnu org licenses( old licenses)? lgpl 2 1
lgpl-3.0 | gnu.org | gnu org licenses lgpl 3 0
agpl-3.0 | gnu.org | gnu org licenses agpl 3 0
gfdl-1.3 | gnu.org | gnu org licenses fdl 1 3
gpl | gnu.org | gnu org (licenses|copyleft) gpl
mpl-2.0 | mozilla.org | mozilla org mpl 2 0
mpl-1.1 | mozilla.org | mozilla org mpl mpl 1 1
epl-2.0 | eclipse.org | eclipse org legal epl (2 0|v20)
epl-1.0 | eclipse.org | eclipse org legal epl v10
cc-by-nc-nd | creativecommons.org | creativecommons org licenses by nc nd
cc-by-nc-sa | creativecommons.org | creativecommons org licenses by nc sa
cc-by-nc | creativecommons.org | creativecommons org licenses by nc
cc-by-nd | creativecommons.org | creativecommons org licenses by nd
cc-by-sa | creativecommons.org | creativecommons org licenses by sa
cc-by | creativecommons.org | creativecommons org licenses by
cc0-1.0 | creativecommons.org | creativecommons org publicdomain zero 1 0
public-domain | creativecommons.org | creativecommons org publicdomain mark 1 0
unlicense | unlicense.org | unlicense org
wtfpl | wtfpl.net | wtfpl net
bsl-1.0 | boost.org | boost org license 1 0
ofl-1.1 | scripts.sil.org | scripts sil org ofl
odbl-1.0 | opendatacommons.org | opendatacommons org licenses odbl
odc-by-1.0 | opendatacommons.org | opendatacommons org licenses by
pddl-1.0 | opendatacommons.org | opendatacommons org licenses pddl
eupl | europa.eu | (joinup ec )?europa eu [a-z0-9 ]{0,40}eupl
cecill | cecill.info | cecill info licen[cs]es?
python-2.0 | python.org | python org [a-z0-9 ]{0,30}license
php-3.01 | php.net | php net license 3 01
"""

NAMES = """
apache-2.0 | apache | apache( software)? licen[cs]e,?( version| v)? ?2( 0)?
apache-1.1 | apache | apache software licen[cs]e( version| v)? ?1 1
apache | apache | apache( software)? licen[cs]e
mit | licen | (the )?mit( x11| expat)? licen[cs]e
bsd-2-clause | bsd | bsd 2 clause|2 clause bsd|simplified bsd
bsd-3-clause | bsd | bsd 3 clause|3 clause bsd|(new|modified|revised) bsd
bsd-4-clause | bsd | bsd 4 clause|4 clause bsd|original bsd
bsd | bsd | bsd( style)? licen[cs]e
isc | licen | isc licen[cs]e
agpl-3.0 | affero | affero general public licen[cs]e,?( version| v)? ?3
agpl | affero | affero general public licen[cs]e
agpl-3.0 | agpl | agpl ?v?3( 0)?
agpl | agpl | agpl
lgpl-2.1 | general public | (lesser|library) general public licen[cs]e,?( version| v)? ?2 1
lgpl-3.0 | general public | (lesser|library) general public licen[cs]e,?( version| v)? ?3
lgpl | general public | (lesser|library) general public licen[cs]e
lgpl-2.1 | lgpl | lgpl ?v?2 1
lgpl-3.0 | lgpl | lgpl ?v?3
lgpl | lgpl | lgpl
gpl-2.0 | general public | general public licen[cs]e,?( version| v)? ?2
gpl-3.0 | general public | general public licen[cs]e,?( version| v)? ?3
gpl | general public | general public licen[cs]e
gpl-2.0 | gpl | gpl ?v?2( 0)?
gpl-3.0 | gpl | gpl ?v?3( 0)?
gpl | gpl | gnu gpl|gpl licen[cs]ed?
gfdl | documentation | gnu free documentation licen[cs]e
mpl-2.0 | mozilla | mozilla public licen[cs]e,?( version| v)? ?2
mpl | mozilla | mozilla public licen[cs]e
epl-2.0 | eclipse | eclipse public licen[cs]e,?( version| v)? ?2
epl | eclipse | eclipse public licen[cs]e
cddl-1.0 | common development | common development and distribution licen[cs]e
cc-by-nc-nd | cc | cc by nc nd
cc-by-nc-sa | cc | cc by nc sa
cc-by-nc | cc | cc by nc
cc-by-nd | cc | cc by nd
cc-by-sa | cc | cc by sa
cc-by | cc | cc by
cc0-1.0 | cc0 | cc0
cc-by-nc-nd | attribution | attribution non ?commercial no ?deriv(s|atives)?
cc-by-nc-sa | attribution | attribution non ?commercial share ?alike
cc-by-nc | attribution | attribution non ?commercial
cc-by-sa | attribution | attribution share ?alike
cc-by | creative commons | creative commons attribution
creative-commons | creative commons | creative commons( licen[cs]e)?
unlicense | unlicense | the unlicense
zlib | zlib | zlib( libpng)? licen[cs]e
bsl-1.0 | boost | boost software licen[cs]e
artistic | artistic | artistic licen[cs]e
ofl-1.1 | open font | (sil )?open font licen[cs]e
odbl-1.0 | open database | open database licen[cs]e
eupl | european union | european union public licen[cs]e
busl-1.1 | business source | business source licen[cs]e
sspl-1.0 | server side | server side public licen[cs]e
ms-pl | microsoft | microsoft public licen[cs]e
public-domain | public domain | public domain
reserved | rights reserved | (all|some) rights reserved
no-rights-reserved | rights reserved | no rights reserved
copyright | copyright | copyright ((c|©) )?((19|20)[0-9]{2}|by )
"""

#: (section, how sure a match makes), in order of priority.
SECTIONS = [("tag", 1.0, TAGS), ("notice", 0.95, NOTICES), ("clause", 0.9, CLAUSES), ("link", 0.85, LINKS), ("name", 0.6, NAMES)]


def rules() -> list[tuple[int, str, str, str, str, float]]:
    """(priority, section, label, keyword, Java or Python regex, sureness) of every rule."""
    out = []
    for section, sure, lines in SECTIONS:
        for line in lines.strip().splitlines():
            label, keyword, pattern = (x.strip() for x in line.split(" | ", 2))
            pattern = pattern.replace(" ?", "[^a-z0-9]*").replace(" ", "[^a-z0-9]+").replace(",?", "")
            out.append((len(out), section, label, keyword, f"(?<![a-z0-9])(?:{pattern})(?![a-z0-9])", sure))
    return out
