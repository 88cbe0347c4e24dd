"""The signatures of the license scan, written by hand, as text.

A line in brackets names the label of the lines below it. A signature is a kind and a regular expression over
lower-case words with single spaces between them (hyphens, points, slashes and the like part words, so 'GPL-2.0'
is 'gpl 2 0'). It begins with a plain word. Words in capitals are its keywords: every text that it matches has them,
and it is tried on texts with all of them only. Kinds, with priority and score: T a sentence of the licence itself,
I an identifier, G a statement that something is under the licence, U an address, N a full name, S a short name,
W a word about rights that names no licence.
"""

from __future__ import annotations

KINDS = {"T": (100, 1.0), "I": (95, 0.99), "G": (90, 0.95), "U": (85, 0.9), "N": (60, 0.8), "S": (40, 0.6), "W": (20, 0.4)}

SIGNATURES = r"""
[mit]
G under the MIT license
G licensed under (?:the )?(?:terms of )?(?:the )?MIT licen[cs]e
G released under (?:the )?(?:terms of )?(?:the )?MIT(?: licen[cs]e)?
G distributed under (?:the )?(?:terms of )?(?:the )?MIT(?: licen[cs]e)?
G available under (?:the )?(?:terms of )?(?:the )?MIT(?: licen[cs]e)?
G MIT licensed
G license MIT
I spdx license identifier MIT
U OPENSOURCE org licenses? MIT(?: license)?(?: php| html)?
N MIT licen[cs]e
N the MIT licen[cs]e MIT
N MIT x11 license
N EXPAT license
T permission is hereby granted free of charge to any person obtaining a copy of this software and associated DOCUMENTATION files
T without restriction including without limitation the rights to use copy modify merge publish distribute SUBLICENSE and or sell copies of the software
T the above copyright notice and this permission notice shall be included in all copies or substantial PORTIONS of the software
T the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of MERCHANTABILITY
T in no event shall the authors or copyright holders be LIABLE for any claim damages or other liability

[mit-0]
I spdx license identifier MIT 0
N MIT no ATTRIBUTION(?: license)?
N MIT 0 license

[x11]
I spdx license identifier X11
N X11 license
N X consortium LICENSE
T except as contained in this notice the name of the x CONSORTIUM shall not be used in advertising

[isc]
I spdx license identifier ISC
G under (?:the )?(?:terms of )?(?:the )?ISC licen[cs]e
N ISC licen[cs]e
T permission to use copy modify and or distribute this software for any purpose with or without FEE is hereby granted
T the software is provided as is and the author disclaims all WARRANTIES with regard to this software

[0bsd]
I spdx license identifier 0BSD
N ZERO clause BSD(?: license)?
N BSD ZERO clause(?: license)?
S 0BSD

[apache-1.1]
I spdx license identifier APACHE 1 1
N APACHE software license version 1 1
N APACHE license (?:version )?1 1

[apache-2]
G APACHE license version 2
G licensed under the APACHE license version 2 0(?: the license)?
G licensed under (?:the )?(?:terms of )?(?:the )?APACHE(?: software)?(?: license)?(?: version)? 2(?: 0)?
G released under (?:the )?(?:terms of )?(?:the )?APACHE(?: software)?(?: license)?(?: version)? v?2(?: 0)?
G distributed under (?:the )?(?:terms of )?(?:the )?APACHE(?: software)?(?: license)?(?: version)? v?2(?: 0)?
G available under (?:the )?(?:terms of )?(?:the )?APACHE(?: software)?(?: license)?(?: version)? v?2(?: 0)?
G license APACHE (?:license )?(?:version )?2(?: 0)?
I spdx license identifier APACHE 2 0
U APACHE org licenses license 2 0(?: txt| html)?
N APACHE license(?: version)? 2(?: 0)?
N APACHE software license(?: version)? 2(?: 0)?
N APACHE licen[cs]e v2(?: 0)?
S APACHE 2(?: 0)? license
S ASL 2 0
T you may not use this file except in COMPLIANCE with the license you may obtain a copy of the license at
T unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is BASIS
T without WARRANTIES or conditions of any kind either express or implied see the license for the specific language GOVERNING permissions and limitations under the license
T each CONTRIBUTOR hereby grants to you a perpetual worldwide non exclusive no charge royalty free IRREVOCABLE copyright license

[apache]
G licensed to the APACHE software FOUNDATION asf under one or more contributor license agreements
G under (?:the )?(?:terms of )?(?:the )?APACHE licen[cs]e
N APACHE licen[cs]e

[bsd-2-clause]
I spdx license identifier BSD 2 clause
N 2 clause BSD(?: license)?
N BSD 2 clause(?: license)?
N two clause BSD(?: license)?
N SIMPLIFIED BSD license
N FREEBSD license
U OPENSOURCE org licenses? BSD 2 clause

[bsd-3-clause]
I spdx license identifier BSD 3 clause
N 3 clause BSD(?: license)?
N BSD 3 clause(?: license)?
N three clause BSD(?: license)?
N new BSD license
N MODIFIED BSD license
N REVISED BSD license
U OPENSOURCE org licenses? BSD 3 clause
T neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to ENDORSE or promote products derived from this software

[bsd-4-clause]
I spdx license identifier BSD 4 clause
N 4 clause BSD(?: license)?
N BSD 4 clause(?: license)?
N original BSD license
N BSD license with advertising clause
T all ADVERTISING materials mentioning features or use of this software must display the following ACKNOWLEDGE?MENT

[bsd]
G under (?:the )?(?:terms of )?(?:the |a )?BSD(?: style)? licen[cs]e
G license BSD
N BSD licen[cs]e
N BSD style licen[cs]e
T redistribution and use in source and binary forms with or without MODIFICATION are permitted provided that the following conditions are met
T REDISTRIBUTIONS of source code must retain the above copyright notice this list of conditions and the following disclaimer
T REDISTRIBUTIONS in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
T this software is provided by the (?:copyright holders and contributors|author|regents and contributors) as is and any EXPRESS or implied warranties
T in no event shall the (?:[^ ]+ ){1,6}be liable for any direct indirect INCIDENTAL special EXEMPLARY or consequential damages

[gpl-1]
I spdx license identifier GPL 1 0(?: only| or later)?
N GNU general public license version 1

[gpl-2]
G under (?:the )?terms of (?:the )?version 2 of (?:the )?GNU general public license
G under (?:the )?(?:terms of )?(?:the )?(?:gnu )?GPL v?2(?: 0)?
G under (?:the )?(?:terms of )?(?:the )?GNU general public license(?: version| v)? ?2(?: 0)?
G under (?:the )?(?:terms of )?(?:the )?GPLV2
G license GPL v?2(?: 0)?
G license GPLV2
I spdx license identifier GPL 2 0(?: only| or later)?
U GNU org licenses old licenses GPL 2 0
N GNU general public license(?: version| v)? ?2(?: 0)?
N general PUBLIC license(?: version| v) ?2(?: 0)?
N GNU GPL(?: version)? v?2(?: 0)?
S GPL(?: version)? v?2(?: 0)?
S GPLV2
S GPL2

[gpl-3]
G under (?:the )?terms of (?:the )?version 3 of (?:the )?GNU general public license
G under (?:the )?(?:terms of )?(?:the )?(?:gnu )?GPL v?3(?: 0)?
G under (?:the )?(?:terms of )?(?:the )?GNU general public license(?: version| v)? ?3(?: 0)?
G under (?:the )?(?:terms of )?(?:the )?GPLV3
G license GPL v?3(?: 0)?
G license GPLV3
I spdx license identifier GPL 3 0(?: only| or later)?
U GNU org licenses GPL 3 0
N GNU general public license(?: version| v)? ?3(?: 0)?
N general PUBLIC license(?: version| v) ?3(?: 0)?
N GNU GPL(?: version)? v?3(?: 0)?
S GPL(?: version)? v?3(?: 0)?
S GPLV3
S GPL3

[gpl]
G under (?:the )?(?:terms of )?(?:the )?GNU general public license
G under (?:the )?(?:terms of )?(?:the )?(?:gnu )?GPL
I spdx license identifier GPL
U GNU org licenses GPL(?: html| txt)?
U GNU org COPYLEFT GPL(?: html| txt)?
N GNU general public licen[cs]e
N GNU GPL
T redistribute it and or modify it under the terms of the GNU general public license as published by the free software FOUNDATION
T either version [1-3] of the license or at your option any LATER version
T without even the implied warranty of MERCHANTABILITY or fitness for a particular purpose see the gnu general public license for more details
T you should have received a copy of the GNU general public license along with this program
T you may copy and distribute VERBATIM copies of the program s source code as you receive it

[lgpl-2]
I spdx license identifier LGPL 2 0(?: only| or later)?
N GNU LIBRARY general public license(?: version)? 2(?: 0)?
N GNU LIBRARY general public license
S LGPL(?: version)? v?2(?: 0)?
S LGPLV2

[lgpl-2.1]
I spdx license identifier LGPL 2 1(?: only| or later)?
G under (?:the )?(?:terms of )?(?:the )?(?:gnu )?LGPL(?: version)? v?2 1
G under (?:the )?(?:terms of )?(?:the )?GNU LESSER general public license(?: version| v)? ?2 1
U GNU org licenses old licenses LGPL 2 1
N GNU LESSER general public license(?: version| v)? ?2 1
S LGPL(?: version)? v?2 1
S LGPLV2 1

[lgpl-3]
I spdx license identifier LGPL 3 0(?: only| or later)?
G under (?:the )?(?:terms of )?(?:the )?(?:gnu )?LGPL(?: version)? v?3(?: 0)?
G under (?:the )?(?:terms of )?(?:the )?GNU LESSER general public license(?: version| v)? ?3(?: 0)?
U GNU org licenses LGPL 3 0
N GNU LESSER general public license(?: version| v)? ?3(?: 0)?
S LGPL(?: version)? v?3(?: 0)?
S LGPLV3

[lgpl]
G under (?:the )?(?:terms of )?(?:the )?GNU LESSER general public license
G under (?:the )?(?:terms of )?(?:the )?(?:gnu )?LGPL
I spdx license identifier LGPL
U GNU org licenses LGPL(?: html| txt)?
N GNU LESSER general public licen[cs]e
N GNU LGPL
T redistribute it and or modify it under the terms of the GNU LESSER general public license as published by the free software foundation
T you should have received a copy of the GNU LESSER general public license along with this library

[agpl-3]
I spdx license identifier AGPL 3 0(?: only| or later)?
G under (?:the )?(?:terms of )?(?:the )?(?:gnu )?AGPL(?: version)? v?3(?: 0)?
G under (?:the )?(?:terms of )?(?:the )?GNU AFFERO general public license(?: version| v)? ?3(?: 0)?
U GNU org licenses AGPL 3 0
N GNU AFFERO general public license(?: version| v)? ?3(?: 0)?
N AFFERO general public license(?: version| v)? ?3(?: 0)?
S AGPL(?: version)? v?3(?: 0)?
S AGPLV3

[agpl]
I spdx license identifier AGPL
N GNU AFFERO general public licen[cs]e
N AFFERO general public licen[cs]e
N GNU AGPL
T you should have received a copy of the GNU AFFERO general public license along with this program

[gfdl]
I spdx license identifier GFDL
G under (?:the )?terms of the GNU free DOCUMENTATION license
U GNU org (?:copyleft|licenses) FDL(?: html| txt)?
N GNU free DOCUMENTATION license
S GFDL
T with no invariant sections no front COVER texts and no back COVER texts

[mpl-1.1]
I spdx license identifier MPL 1 1
G subject to the MOZILLA public license version 1 1
U MOZILLA org MPL mpl 1 1
N MOZILLA public license(?: version)? 1 1

[mpl-2]
I spdx license identifier MPL 2 0
G subject to the terms of the MOZILLA public license v ?2 0
G under (?:the )?(?:terms of )?(?:the )?MOZILLA public license(?: version| v)? ?2(?: 0)?
U MOZILLA org MPL 2 0
N MOZILLA public license(?: version| v)? ?2(?: 0)?
S MPL(?: version)? v?2(?: 0)?
T if a copy of the MPL was not distributed with this file you can obtain one at

[mpl]
I spdx license identifier MPL
N MOZILLA public licen[cs]e
T this source code form is subject to the terms of the MOZILLA public license

[epl-1]
I spdx license identifier EPL 1 0
U ECLIPSE org legal EPL v10(?: html)?
N ECLIPSE public license(?: version| v)? ?1(?: 0)?
S EPL v?1 0

[epl-2]
I spdx license identifier EPL 2 0
U ECLIPSE org legal EPL (?:2 0|v20)(?: html)?
N ECLIPSE public license(?: version| v)? ?2(?: 0)?
S EPL v?2 0

[epl]
N ECLIPSE public licen[cs]e
T this program and the accompanying materials are made available under the terms of the ECLIPSE public license

[edl]
U ECLIPSE org org documents EDL v10
N ECLIPSE distribution license(?: v 1 0)?

[cpl]
I spdx license identifier CPL 1 0
N COMMON public license(?: version)?(?: 1 0)?

[ipl]
I spdx license identifier IPL 1 0
N IBM public license(?: version)?(?: 1 0)?

[cddl]
I spdx license identifier CDDL 1 [01]
G under (?:the )?terms of the COMMON development and distribution license
N COMMON DEVELOPMENT and distribution license
S CDDL(?: version)?(?: v?1 [01])?
T you may not use this file except in compliance with the license you can obtain a copy of the license at (?:[^ ]+ ){1,12}CDDL

[artistic-1]
I spdx license identifier ARTISTIC 1 0(?: perl)?
N ARTISTIC license(?: version)? 1 0

[artistic-2]
I spdx license identifier ARTISTIC 2 0
N ARTISTIC license(?: version)? 2(?: 0)?

[artistic]
G under the same terms as PERL itself
N ARTISTIC licen[cs]e

[boost]
I spdx license identifier BSL 1 0
G distributed under the BOOST software license(?: version 1 0)?
U BOOST org license 1 0(?: txt)?
N BOOST software license(?: version)?(?: 1 0)?
T permission is hereby granted free of charge to any person or ORGANIZATION obtaining a copy of the software and accompanying documentation

[busl]
I spdx license identifier BUSL 1 1
N BUSINESS source license(?: 1 1)?

[zlib]
I spdx license identifier ZLIB
N ZLIB licen[cs]e
N ZLIB libpng licen[cs]e
T this software is provided as is without any express or implied WARRANTY in no event will the authors be held liable
T the origin of this software must not be MISREPRESENTED you must not claim that you wrote the original software
T altered source versions must be PLAINLY marked as such and must not be misrepresented as being the original software

[libpng]
I spdx license identifier LIBPNG(?: 2 0)?
N LIBPNG license

[unlicense]
I spdx license identifier UNLICENSE
U UNLICENSE org
N the UNLICENSE
G under (?:the )?UNLICENSE
T this is free and UNENCUMBERED software released into the public domain
T anyone is free to copy modify publish use COMPILE sell or distribute this software

[wtfpl]
I spdx license identifier WTFPL
N do what the [^ ]+ you want to public LICENSE
S WTFPL

[beerware]
I spdx license identifier BEERWARE
N BEERWARE license
N BEER WARE license

[python]
I spdx license identifier PYTHON 2 0
I spdx license identifier PSF 2 0
N PYTHON software FOUNDATION license
N PSF license
T PSF is making PYTHON available to licensee on an as is basis

[postgresql]
I spdx license identifier POSTGRESQL
N POSTGRESQL licen[cs]e

[php]
I spdx license identifier PHP 3 01?
N PHP license(?: version)? 3 01?

[ruby]
I spdx license identifier RUBY
N RUBY license
G under the same terms as RUBY

[openssl]
I spdx license identifier OPENSSL
N OPENSSL license
T this product includes software developed by the OPENSSL project for use in the openssl toolkit

[curl]
I spdx license identifier CURL
N CURL license

[ncsa]
I spdx license identifier NCSA
N university of ILLINOIS ncsa open source license
N NCSA open source license

[w3c]
I spdx license identifier W3C
N W3C software (?:notice and )?license
N W3C software and document NOTICE and license

[ms-pl]
I spdx license identifier MS PL
N MICROSOFT public license(?: ms pl)?

[ms-rl]
I spdx license identifier MS RL
N MICROSOFT RECIPROCAL license(?: ms rl)?

[upl]
I spdx license identifier UPL 1 0
N UNIVERSAL PERMISSIVE license(?: v(?:ersion)? 1 0)?

[afl]
I spdx license identifier AFL [1-3] [01]
N ACADEMIC free license(?: v(?:ersion)?(?: [1-3] [01])?)?

[osl]
I spdx license identifier OSL [1-3] [01]
N OPEN SOFTWARE license(?: v(?:ersion)? [1-3] [01])

[eupl]
I spdx license identifier EUPL 1 [012]
N EUROPEAN union public licen[cs]e
S EUPL(?: v?1 [012])?

[cecill]
I spdx license identifier CECILL(?: [bc]| [12] [01])?
N CECILL licen[cs]e
S CECILL(?: [bc])?

[ofl]
I spdx license identifier OFL 1 [01]
G licensed under the SIL open font license(?: version 1 1)?
U SCRIPTS SIL org OFL
N SIL open font license(?: version)?(?: 1 [01])?
T the font software may be sold as part of a larger software package but no copy of one or more of the OFL typefaces

[odbl]
I spdx license identifier ODBL 1 0
U OPENDATACOMMONS org licenses ODBL(?: 1 0)?
N open DATABASE licen[cs]e
S ODBL

[odc-by]
I spdx license identifier ODC by 1 0
U OPENDATACOMMONS org licenses by(?: 1 0)?
N open data commons ATTRIBUTION licen[cs]e

[pddl]
I spdx license identifier PDDL 1 0
U OPENDATACOMMONS org licenses PDDL
N public domain DEDICATION and licen[cs]e

[cdla]
I spdx license identifier CDLA (?:permissive|sharing) [12] 0
N community data license AGREEMENT (?:permissive|sharing)

[ogl]
I spdx license identifier OGL uk [1-3] 0
N open GOVERNMENT licen[cs]e(?: v ?[1-3] 0)?

[openrail]
I spdx license identifier (?:creativeml )?OPENRAIL m
N CREATIVEML open RAIL m
N responsible ai LICENSE

[cc0]
I spdx license identifier CC0 1 0
U CREATIVECOMMONS org publicdomain ZERO 1 0
N creative COMMONS ZERO(?: v?1 0)?(?: universal)?
N CC0 public domain DEDICATION
S CC0(?: 1 0)?(?: universal)?
S CC ZERO
T the person who associated a work with this DEED has dedicated the work to the public domain

[cc-pdm]
U CREATIVECOMMONS org publicdomain MARK 1 0
N public domain MARK(?: 1 0)?

[cc-by]
I spdx license identifier CC BY [1-4] [05]
U CREATIVECOMMONS org licenses by [1-4] [05]
G under (?:a |the )?creative COMMONS ATTRIBUTION(?: [1-4] [05])?(?: international| unported| generic)? licen[cs]e
N creative COMMONS ATTRIBUTION(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
S CC BY(?: [1-4] [05])?

[cc-by-sa]
I spdx license identifier CC BY SA [1-4] [05]
U CREATIVECOMMONS org licenses by SA [1-4] [05]
N creative COMMONS ATTRIBUTION share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
S CC BY SA(?: [1-4] [05])?

[cc-by-nd]
I spdx license identifier CC BY ND [1-4] [05]
U CREATIVECOMMONS org licenses by ND [1-4] [05]
N creative COMMONS ATTRIBUTION no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
S CC BY ND(?: [1-4] [05])?

[cc-by-nc]
G CC BY NC
I spdx license identifier CC BY NC [1-4] [05]
U CREATIVECOMMONS org licenses by NC [1-4] [05]
N creative COMMONS ATTRIBUTION non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
S CC BY NC(?: [1-4] [05])?

[cc-by-nc-sa]
I spdx license identifier CC BY NC SA [1-4] [05]
U CREATIVECOMMONS org licenses by NC SA [1-4] [05]
N creative COMMONS ATTRIBUTION non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
S CC BY NC SA(?: [1-4] [05])?

[cc-by-nc-nd]
I spdx license identifier CC BY NC ND [1-4] [05]
U CREATIVECOMMONS org licenses by NC ND [1-4] [05]
N creative COMMONS ATTRIBUTION non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
S CC BY NC ND(?: [1-4] [05])?

[cc]
G licensed under (?:a |the )?creative COMMONS licen[cs]e
G under (?:a |the )?creative COMMONS licen[cs]e
N creative COMMONS licen[cs]e
U CREATIVECOMMONS org licenses

[public-domain]
G released (?:in)?to the public DOMAIN
G placed (?:in|into) the public DOMAIN
G dedicated to the public DOMAIN
G has been put in the public DOMAIN
N public DOMAIN dedication

[llama]
N LLAMA [2-4](?: [1-3])? community license(?: agreement)?

[sspl]
I spdx license identifier SSPL 1 0
N server side public LICENSE(?: v 1)?
S SSPL

[elastic]
I spdx license identifier ELASTIC 2 0
N ELASTIC license(?: 2 0)?

[json]
T the software shall be used for good not EVIL

[freetype]
I spdx license identifier FTL
N FREETYPE project license

[ijg]
I spdx license identifier IJG
T this software is based in part on the work of the INDEPENDENT jpeg group

[unicode]
I spdx license identifier UNICODE (?:dfs 2016|3 0|tou)
N UNICODE license(?: v3| agreement)

[icu]
I spdx license identifier ICU
N ICU license

[vim]
I spdx license identifier VIM
N VIM license

[lppl]
I spdx license identifier LPPL 1 [0-3][abc]?
N LATEX project public license
S LPPL(?: version)?(?: 1 [0-3][abc]?)?

[qpl]
I spdx license identifier QPL 1 0
N Q PUBLIC license(?: version)?

[sleepycat]
I spdx license identifier SLEEPYCAT
N SLEEPYCAT license

[tcl]
I spdx license identifier TCL
N TCL TK license

[zpl]
I spdx license identifier ZPL [12] [01]
N ZOPE public license(?: version)?(?: [12] [01])?

[mulan]
I spdx license identifier MULANPSL [12] 0
N MULAN permissive software license

[hippocratic]
I spdx license identifier HIPPOCRATIC 2 1
N HIPPOCRATIC license

[blueoak]
I spdx license identifier BLUEOAK 1 0 0
N BLUE OAK model license

[proprietary]
W this software is CONFIDENTIAL and proprietary
W unauthorized copying of this file via any medium is strictly PROHIBITED
W proprietary and CONFIDENTIAL
W may not be reproduced (?:or )?distributed (?:or )?transmitted in any form or by any means without the prior written PERMISSION
W no part of this publication may be REPRODUCED

[all-rights-reserved]
W all rights RESERVED
W some rights RESERVED
W tous droits RÉSERVÉS
W todos los derechos RESERVADOS
W alle rechte VORBEHALTEN
"""
