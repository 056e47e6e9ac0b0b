"""Signature rules of licenses, written by hand over the words of a text: lower case, one blank between words, no punctuation.

A line is ``level | label | keywords | pattern``. A rule runs only where each of its keywords begins a word of the text; the
pattern matches whole words. No keyword begins another, so one pass finds all that occur. Levels, from the surest down: ``tag`` (a machine-readable identifier), ``text`` (a passage of a license or
its standard notice), ``url`` (its address), ``name`` (its name, with or without a version), ``mention`` (a hint).
"""

from __future__ import annotations

from typing import NamedTuple

#: level -> (priority, confidence of a match)
LEVELS = {"tag": (5, 1.0), "text": (4, 0.95), "url": (3, 0.85), "name": (2, 0.7), "mention": (1, 0.3)}

TABLE = r"""
tag | mit | spdx | spdx license identifier mit(?! 0)
tag | mit-0 | spdx | spdx license identifier mit 0
tag | apache-2.0 | spdx,apache | spdx license identifier apache 2 0
tag | apache-1.1 | spdx,apache | spdx license identifier apache 1 1
tag | gpl-2.0-only | spdx,gpl | spdx license identifier gpl 2 0(?: only)?(?! or later)
tag | gpl-2.0-or-later | spdx,gpl | spdx license identifier gpl 2 0 or later
tag | gpl-3.0-only | spdx,gpl | spdx license identifier gpl 3 0(?: only)?(?! or later)
tag | gpl-3.0-or-later | spdx,gpl | spdx license identifier gpl 3 0 or later
tag | lgpl-2.1-only | spdx,lgpl | spdx license identifier lgpl 2 1(?: only)?(?! or later)
tag | lgpl-2.1-or-later | spdx,lgpl | spdx license identifier lgpl 2 1 or later
tag | lgpl-3.0-only | spdx,lgpl | spdx license identifier lgpl 3 0(?: only)?(?! or later)
tag | lgpl-3.0-or-later | spdx,lgpl | spdx license identifier lgpl 3 0 or later
tag | agpl-3.0-only | spdx,agpl | spdx license identifier agpl 3 0(?: only)?(?! or later)
tag | agpl-3.0-or-later | spdx,agpl | spdx license identifier agpl 3 0 or later
tag | bsd-2-clause | spdx,bsd | spdx license identifier bsd 2 clause
tag | bsd-3-clause | spdx,bsd | spdx license identifier bsd 3 clause
tag | bsd-4-clause | spdx,bsd | spdx license identifier bsd 4 clause
tag | 0bsd | spdx,0bsd | spdx license identifier 0bsd
tag | isc | spdx,isc | spdx license identifier isc
tag | mpl-2.0 | spdx,mpl | spdx license identifier mpl 2 0
tag | mpl-1.1 | spdx,mpl | spdx license identifier mpl 1 1
tag | epl-1.0 | spdx,epl | spdx license identifier epl 1 0
tag | epl-2.0 | spdx,epl | spdx license identifier epl 2 0
tag | cddl-1.0 | spdx,cddl | spdx license identifier cddl 1 0
tag | cddl-1.1 | spdx,cddl | spdx license identifier cddl 1 1
tag | cc0-1.0 | spdx,cc | spdx license identifier cc0 1 0
tag | cc-by-3.0 | spdx,cc | spdx license identifier cc by 3 0
tag | cc-by-4.0 | spdx,cc | spdx license identifier cc by 4 0
tag | cc-by-sa-3.0 | spdx,cc | spdx license identifier cc by sa 3 0
tag | cc-by-sa-4.0 | spdx,cc | spdx license identifier cc by sa 4 0
tag | cc-by-nc-4.0 | spdx,cc | spdx license identifier cc by nc 4 0
tag | unlicense | spdx,unlicen | spdx license identifier unlicense
tag | wtfpl | spdx,wtfpl | spdx license identifier wtfpl
tag | zlib | spdx,zlib | spdx license identifier zlib
tag | bsl-1.0 | spdx,bsl | spdx license identifier bsl 1 0
tag | artistic-2.0 | spdx,artistic | spdx license identifier artistic 2 0
tag | ofl-1.1 | spdx,ofl | spdx license identifier ofl 1 1
tag | eupl-1.2 | spdx,eupl | spdx license identifier eupl 1 2
tag | postgresql | spdx,postgresql | spdx license identifier postgresql
tag | python-2.0 | spdx | spdx license identifier (?:python|psf) 2 0
tag | upl-1.0 | spdx,upl | spdx license identifier upl 1 0
tag | busl-1.1 | spdx,busl | spdx license identifier busl 1 1
tag | sspl-1.0 | spdx,sspl | spdx license identifier sspl 1 0
tag | ms-pl | spdx | spdx license identifier ms pl
tag | nasa-1.3 | spdx,nasa | spdx license identifier nasa 1 3
tag | cecill-2.1 | spdx,cecill | spdx license identifier cecill 2 1
tag | gfdl-1.3 | spdx,gfdl | spdx license identifier gfdl 1 3(?: or later| only)?
text | mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
text | mit | permission,notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
text | mit | warrant,merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
text | mit | licen | (?:this|the) (?:\S+ ){1,4}(?:is|are) (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[cs]e
text | mit | licen | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[cs]e
text | apache-2.0 | licen,apache | licensed under the apache license,? version 2(?: 0)?(?: the license)?(?: you may not use this file except in compliance with the license)?
text | apache-2.0 | licen | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
text | apache-2.0 | licen,compliance | you may not use this file except in compliance with the license
text | apache-2.0 | licen,apache | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache (?:software )?licen[cs]e(?: version)? 2(?: 0)?
text | apache-2.0 | contributor,perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
text | apache-2.0 | licen,apache,foundation | licensed to the apache software foundation asf under one or more contributor license agreements
text | apache-1.1 | apache | this product includes software developed by the apache software foundation
text | gpl-2.0-or-later | licen,redistribut | (?:you can )?redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
text | gpl-3.0-or-later | licen,redistribut | (?:you can )?redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
text | gpl-2.0-only | licen,redistribut | (?:you can )?redistribute it and or modify it under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation
text | gpl-3.0-only | licen,redistribut | (?:you can )?redistribute it and or modify it under the terms of the gnu general public license version 3(?: only)? as published by the free software foundation
text | lgpl-2.1-or-later | licen,lesser | (?:you can )?redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
text | lgpl-3.0-or-later | licen,lesser | (?:you can )?redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
text | lgpl-2.0-or-later | licen,library | (?:you can )?redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
text | agpl-3.0-or-later | licen,affero | (?:you can )?redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
text | gpl-3.0 | gnu | (?:this work is |this program is |it is )?(?:released|licensed|distributed|available|published) under the (?:terms of the )?gnu (?:general public licen[cs]e|gpl) (?:version |v ?)?3(?: 0)?(?! or later)
text | gpl-2.0 | gnu | (?:this work is |this program is |it is )?(?:released|licensed|distributed|available|published) under the (?:terms of the )?gnu (?:general public licen[cs]e|gpl) (?:version |v ?)?2(?: 0)?(?! or later)
text | gpl | licen,gnu | you should have received a copy of the gnu general public license along with (?:this|\S+) \S+
text | lgpl | licen,lesser | you should have received a copy of the gnu lesser general public license along with (?:this|\S+) \S+
text | agpl | licen,affero | you should have received a copy of the gnu affero general public license along with (?:this|\S+) \S+
text | gpl | licen,copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
text | gpl | licen,freedom | the licenses for most software are designed to take away your freedom to share and change it
text | agpl | network | if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
text | bsd-3-clause | endorse | neither the name of (?:the )?(?:\S+ ){1,12}nor the names of (?:its|any|their) (?:contributors|other contributors) may be used to endorse or promote products derived from this software without specific prior written permission
text | bsd-2-clause | redistribut,binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
text | bsd | redistribut,source | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
text | bsd | redistribut,permitted | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
text | bsd-4-clause | advertising,acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
text | bsd | contributor,warrant | this software is provided by the copyright holders and contributors as is and any express or implied warranties
text | bsd-3-clause | licen,bsd | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?(?:3|three) clause bsd licen[cs]e
text | bsd-2-clause | licen,bsd | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?(?:2|two) clause bsd licen[cs]e
text | bsd | licen,bsd | (?:governed by|released under|licensed under|distributed under) (?:the |a )?bsd (?:style )?licen[cs]e
text | isc | permission,distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
text | isc | disclaims | the software is provided as is and the author disclaims all warranties with regard to this software
text | isc | licen,isc | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?isc licen[cs]e
text | mpl-2.0 | licen,mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
text | mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
text | mpl-1.1 | licen,mozilla,contents | the contents of this file are subject to the mozilla public license version 1 1
text | mpl-1.0 | licen,mozilla,contents | the contents of this file are subject to the mozilla public license version 1 0
text | epl-1.0 | eclipse,accompanying | (?:this program and the|all rights reserved this program and the) accompanying materials are made available under the terms of the eclipse public license v 1 0
text | epl-2.0 | licen,eclipse,accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
text | cddl-1.0 | licen,development | the contents of this file are subject to the terms of the common development and distribution license
text | unlicense | domain,unencumbered | this is free and unencumbered software released into the public domain
text | unlicense | publish,compile | anyone is free to copy modify publish use compile sell or distribute this software
text | cc0-1.0 | copyright,related | (?:to the extent possible under law )?the (?:author|person who associated cc0 with this work)(?: \S+){0,4} (?:has|have) (?:waived|dedicated) all copyright and related(?: or|and)? (?:neighboring|neighbouring) rights
text | public-domain | domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
text | public-domain | domain | (?:this|the) (?:file|work|code|software|text|document|program) is (?:in|hereby placed in) the public domain
text | wtfpl | want | do what the (?:fuck|f) you want to(?: public license)?
text | zlib | liable | in no event will the authors be held liable for any damages arising from the use of this software
text | zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
text | bsl-1.0 | licen,boost | distributed under the boost software license version 1 0
text | bsl-1.0 | licen,permission,accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
text | artistic-2.0 | artistic | (?:you may|it may be) (?:\S+ ){0,8}under the (?:terms of the )?artistic license 2 0
text | perl | perl | under the same terms as perl itself
text | ofl-1.1 | licen,font | this font software is licensed under the sil open font license version 1 1
text | python-2.0 | licen,psf,python | psf is making python available to licensee on an as is basis
text | postgresql | permission,fee | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
text | ncsa | licen,ncsa | university of illinois ncsa open source license
text | openssl | openssl,toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
text | cc-by-4.0 | creative | (?:this work is |released |available |content is )?(?:licensed )?under (?:a |the )?creative commons attribution 4 0 international(?: licen[cs]e)?
text | cc-by-3.0 | creative | (?:this work is |released |available |content is )?(?:licensed )?under (?:a |the )?creative commons attribution 3 0(?: unported| \S+)?(?: licen[cs]e)?
text | cc-by-sa-4.0 | creative | (?:this work is |released |available |content is )?(?:licensed )?under (?:a |the )?creative commons attribution share ?alike 4 0 international(?: licen[cs]e)?
text | cc-by-sa-3.0 | creative | (?:this work is |released |available |content is )?(?:licensed )?under (?:a |the )?creative commons attribution share ?alike 3 0(?: unported| \S+)?(?: licen[cs]e)?
text | cc-by-nc-4.0 | creative | (?:this work is |released |available |content is )?(?:licensed )?under (?:a |the )?creative commons attribution non ?commercial 4 0 international(?: licen[cs]e)?
text | cc-by-nd-4.0 | creative | (?:this work is |released |available |content is )?(?:licensed )?under (?:a |the )?creative commons attribution no ?deriv(?:ative|ative work)?s? 4 0 international(?: licen[cs]e)?
text | cc-by-nc-sa-4.0 | creative | (?:this work is |released |available |content is )?(?:licensed )?under (?:a |the )?creative commons attribution non ?commercial share ?alike 4 0 international(?: licen[cs]e)?
text | cc-by-nc-nd-4.0 | creative | (?:this work is |released |available |content is )?(?:licensed )?under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s? 4 0 international(?: licen[cs]e)?
text | cc-by-4.0 | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by 4 0
text | cc-by-3.0 | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by 3 0
text | cc-by-sa-4.0 | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by sa 4 0
text | cc-by-sa-3.0 | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by sa 3 0
text | cc-by-nc-4.0 | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by nc 4 0
text | cc-by-nc-3.0 | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by nc 3 0
text | cc-by-nd-4.0 | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by nd 4 0
text | cc-by-nc-sa-4.0 | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by nc sa 4 0
text | cc-by-nc-nd-4.0 | cc | (?:released|licensed|distributed|available|published) under (?:a |the )?cc by nc nd 4 0
text | gfdl-1.2 | licen,documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
text | gfdl-1.3 | licen,documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
text | eupl-1.2 | licen | licensed under the (?:eupl|european union public licen[cs]e)(?: version| v)? ?1 2
text | sspl-1.0 | server | (?:licensed under|terms of) the server side public license(?: version| v)? ?1
text | busl-1.1 | business | (?:licensed under|use of this software is governed by) the business source license(?: 1 1)?
text | commons-clause | licen | the software is provided to you by the licensor under the license as defined below subject to the following condition
text | elastic-2.0 | elastic | (?:licensed under|subject to) the elastic license(?: version| v)? ?2 0
text | odbl-1.0 | licen,database | (?:made )?available under the open database license
text | odc-by-1.0 | licen,attribution | (?:made )?available under the open data commons attribution license
text | ogl-3.0 | licen,government | (?:contains public sector information )?licensed under the open government licen[cs]e(?: v| version)? ?3 0
text | proprietary | confidential | (?:this|the) (?:\S+ ){1,5}(?:is|are|contains) (?:confidential and proprietary|proprietary and confidential)(?: information)?
text | proprietary | permission | no part of this (?:\S+ ){1,4}may be reproduced (?:\S+ ){0,12}without (?:the )?(?:prior |express |prior written |written )?permission
text | proprietary | unauthori | unauthori[sz]ed copying of this file via any medium is strictly prohibited
url | mit | licen,opensource | (?:www )?opensource org licenses mit(?: license)?(?: php)?
url | apache-2.0 | licen,apache | (?:www )?apache org licenses license 2 0(?: txt| html)?
url | apache-1.1 | licen,apache | (?:www )?apache org licenses license 1 1
url | gpl | licen,gnu | (?:www )?gnu org licenses(?: gpl)?(?: html| txt)?
url | gpl-2.0 | licen,gnu | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
url | gpl-3.0 | licen,gnu | (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
url | lgpl-2.1 | licen,gnu | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
url | lgpl-3.0 | licen,gnu | (?:www )?gnu org licenses lgpl 3 0(?: html| txt)?
url | agpl-3.0 | licen,gnu | (?:www )?gnu org licenses agpl 3 0(?: html| txt)?
url | gfdl-1.3 | licen,gnu | (?:www )?gnu org licenses fdl 1 3(?: html| txt)?
url | bsd-3-clause | opensource,licen | (?:www )?opensource org licenses bsd (?:3 clause|license)
url | bsd-2-clause | licen,opensource | (?:www )?opensource org licenses bsd 2 clause
url | isc | licen,opensource | (?:www )?opensource org licenses isc(?: license)?
url | mpl-2.0 | mozilla,mpl | (?:www )?mozilla org (?:en us )?mpl 2 0
url | mpl-1.1 | mozilla,mpl | (?:www )?mozilla org mpl (?:mpl )?1 1(?: html)?
url | epl-1.0 | eclipse,epl | (?:www )?eclipse org (?:legal|org documents) epl v10(?: html)?
url | epl-2.0 | eclipse,epl | (?:www )?eclipse org (?:legal|org documents) epl (?:2 0|v20)(?: html)?
url | cc0-1.0 | creative,zero | (?:www )?creativecommons org publicdomain zero 1 0(?: legalcode)?
url | public-domain | creative,mark | (?:www )?creativecommons org publicdomain mark 1 0
url | cc-by-2.0 | creative | (?:www )?creativecommons org licenses by 2 0(?: legalcode| deed)?
url | cc-by-3.0 | creative | (?:www )?creativecommons org licenses by 3 0(?: legalcode| deed)?
url | cc-by-4.0 | creative | (?:www )?creativecommons org licenses by 4 0(?: legalcode| deed)?
url | cc-by-sa-2.0 | creative | (?:www )?creativecommons org licenses by sa 2 0(?: legalcode| deed)?
url | cc-by-sa-3.0 | creative | (?:www )?creativecommons org licenses by sa 3 0(?: legalcode| deed)?
url | cc-by-sa-4.0 | creative | (?:www )?creativecommons org licenses by sa 4 0(?: legalcode| deed)?
url | cc-by-nc-3.0 | creative | (?:www )?creativecommons org licenses by nc 3 0(?: legalcode| deed)?
url | cc-by-nc-4.0 | creative | (?:www )?creativecommons org licenses by nc 4 0(?: legalcode| deed)?
url | cc-by-nd-4.0 | creative | (?:www )?creativecommons org licenses by nd 4 0(?: legalcode| deed)?
url | cc-by-nc-sa-4.0 | creative | (?:www )?creativecommons org licenses by nc sa 4 0(?: legalcode| deed)?
url | cc-by-nc-nd-4.0 | creative | (?:www )?creativecommons org licenses by nc nd 4 0(?: legalcode| deed)?
url | unlicense | unlicen | (?:www )?unlicense org
url | wtfpl | wtfpl | (?:www )?wtfpl net
url | bsl-1.0 | licen,boost | (?:www )?boost org license 1 0(?: txt)?
url | ofl-1.1 | sil | scripts sil org ofl
url | artistic-2.0 | licen,opensource | (?:www )?opensource org licenses artistic 2 0
url | zlib | licen,zlib | (?:www )?zlib net zlib license html
name | mit | licen | (?:the )?mit licen[cs]e
name | mit | licen | (?:the )?expat licen[cs]e
name | mit-0 | attribution | mit no attribution(?: licen[cs]e)?
name | apache-2.0 | licen,apache | apache (?:software )?licen[cs]e(?: version| v)? ?2(?: 0)?
name | apache-2.0 | apache | apache 2 0(?: licen[cs]e)?
name | apache-1.1 | licen,apache | apache (?:software )?licen[cs]e(?: version| v)? ?1 1
name | apache | licen,apache | apache (?:software )?licen[cs]e
name | gpl | licen,general | gnu general public licen[cs]e
name | gpl | licen,general | general public licen[cs]e
name | gpl-2.0 | licen,general | (?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?
name | gpl-3.0 | licen,general | (?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?
name | gpl-2.0 | gpl | (?:gnu )?gpl(?:v2| v 2| version 2| 2)(?: 0)?
name | gpl-3.0 | gpl | (?:gnu )?gpl(?:v3| v 3| version 3| 3)(?: 0)?
name | gpl | gnu | gnu gpl
name | lgpl | licen,lesser | (?:gnu )?lesser general public licen[cs]e
name | lgpl-2.1 | licen,lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1
name | lgpl-3.0 | licen,lesser | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?
name | lgpl-2.1 | lgpl | (?:gnu )?lgpl(?:v2 1| v 2 1| version 2 1| 2 1)
name | lgpl-3.0 | lgpl | (?:gnu )?lgpl(?:v3| v 3| version 3| 3)(?: 0)?
name | lgpl-2.0 | licen,library | (?:gnu )?library general public licen[cs]e(?: version 2)?
name | agpl-3.0 | licen,affero | (?:gnu )?affero general public licen[cs]e(?: version| v)?(?: 3(?: 0)?)?
name | agpl-3.0 | agpl | (?:gnu )?agpl(?:v3| v 3| version 3| 3)?(?: 0)?
name | bsd-2-clause | bsd | (?:2|two) clause bsd(?: licen[cs]e)?
name | bsd-2-clause | licen,simplified | simplified bsd licen[cs]e
name | bsd-2-clause | licen,freebsd | freebsd licen[cs]e
name | bsd-3-clause | bsd,clause | (?:3|three) clause bsd(?: licen[cs]e)?
name | bsd-3-clause | bsd,licen | (?:new|modified|revised) bsd licen[cs]e
name | bsd-4-clause | bsd,licen | (?:original|old|4 clause|four clause) bsd licen[cs]e
name | bsd | licen,bsd | (?:the )?bsd licen[cs]e
name | 0bsd | licen,zero | (?:bsd )?zero clause(?: bsd)? licen[cs]e
name | isc | licen,isc | isc licen[cs]e
name | mpl-2.0 | licen,mozilla | mozilla public licen[cs]e(?: version| v)? ?2 0
name | mpl-1.1 | licen,mozilla | mozilla public licen[cs]e(?: version| v)? ?1 1
name | mpl | licen,mozilla | mozilla public licen[cs]e
name | epl-1.0 | licen,eclipse | eclipse public licen[cs]e(?: version| v)? ?1 0
name | epl-2.0 | licen,eclipse | eclipse public licen[cs]e(?: version| v)? ?2 0
name | epl | licen,eclipse | eclipse public licen[cs]e
name | edl-1.0 | licen,eclipse | eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)?
name | cddl | licen,development | common development and distribution licen[cs]e(?: cddl)?(?: version| v)?(?: 1 [01])?
name | cpl-1.0 | licen,common | common public licen[cs]e(?: version| v)?(?: 1 0)?
name | cc0-1.0 | cc | cc0(?: 1 0)?(?: universal)?
name | cc-by-4.0 | cc | cc by 4 0
name | cc-by-3.0 | cc | cc by 3 0
name | cc-by-2.0 | cc | cc by 2 0
name | cc-by-sa-4.0 | cc | cc by sa 4 0
name | cc-by-sa-3.0 | cc | cc by sa 3 0
name | cc-by-sa-2.0 | cc | cc by sa 2 0
name | cc-by-nc-4.0 | cc | cc by nc 4 0
name | cc-by-nc-3.0 | cc | cc by nc 3 0
name | cc-by-nc-2.0 | cc | cc by nc 2 0
name | cc-by-nd-4.0 | cc | cc by nd 4 0
name | cc-by-nd-3.0 | cc | cc by nd 3 0
name | cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
name | cc-by-nc-sa-3.0 | cc | cc by nc sa 3 0
name | cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
name | cc-by-nc-nd-3.0 | cc | cc by nc nd 3 0
name | cc-by | creative | creative commons attribution(?: licen[cs]e)?
name | cc-by-sa | creative | creative commons attribution share ?alike(?: licen[cs]e)?
name | cc-by-nc | creative | creative commons attribution non ?commercial(?: licen[cs]e)?
name | cc-by-nd | creative | creative commons attribution no ?deriv(?:ative|ative work)?s?(?: licen[cs]e)?
name | cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?
name | cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative|ative work)?s?(?: licen[cs]e)?
name | cc0-1.0 | creative | creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: public domain dedication)?
name | unlicense | unlicen | (?:the )?unlicense(?: license)?
name | wtfpl | wtfpl | wtfpl(?: version 2)?
name | zlib | licen,zlib | zlib (?:libpng )?licen[cs]e
name | libpng | licen,libpng | libpng licen[cs]e
name | bsl-1.0 | licen,boost | boost software licen[cs]e(?: version| v)?(?: 1 0)?
name | artistic-1.0 | licen,artistic | artistic licen[cs]e(?: version| v)? ?1 0
name | artistic-2.0 | licen,artistic | artistic licen[cs]e(?: version| v)? ?2 0
name | artistic | licen,artistic | (?:perl )?artistic licen[cs]e
name | ofl-1.1 | licen,font | (?:sil )?open font licen[cs]e(?: version| v)?(?: 1 1)?
name | python-2.0 | licen,python | python software foundation licen[cs]e(?: version| v)?(?: 2)?
name | php-3.0 | licen,php | php licen[cs]e(?: version| v)?(?: 3 0[1]?)?
name | ruby | licen,ruby | ruby licen[cs]e
name | postgresql | licen,postgresql | postgresql licen[cs]e
name | vim | licen,vim | vim licen[cs]e
name | ncsa | licen,ncsa | ncsa open source licen[cs]e
name | afl-3.0 | licen,academic | academic free licen[cs]e(?: version| v)?(?: [123] [01])?
name | osl-3.0 | licen | open software licen[cs]e(?: version| v)?(?: 3 0)?
name | upl-1.0 | licen,universal | universal permissive licen[cs]e(?: version| v)?(?: 1 0)?
name | ms-pl | licen,microsoft | microsoft public licen[cs]e
name | ms-rl | licen,microsoft | microsoft reciprocal licen[cs]e
name | eupl-1.2 | licen | european union public licen[cs]e(?: version| v)?(?: 1 [12])?
name | cecill | cecill | cecill(?: [abc])?(?: licen[cs]e)?
name | lppl-1.3 | licen,latex | latex project public licen[cs]e(?: version| v)?(?: 1 3[abc]?)?
name | gfdl | licen,documentation | (?:gnu )?free documentation licen[cs]e(?: version| v)?(?: 1 [123])?
name | odbl-1.0 | licen,database | open database licen[cs]e(?: odbl)?(?: version| v)?(?: 1 0)?
name | pddl-1.0 | licen,dedication | (?:open data commons )?public domain dedication and licen[cs]e
name | ogl | licen,government | open government licen[cs]e(?: version| v)?(?: [123] 0)?
name | sspl-1.0 | licen,server | server side public licen[cs]e(?: version| v)?(?: 1)?
name | busl-1.1 | licen,business | business source licen[cs]e(?: version| v)?(?: 1 1)?
name | commons-clause | clause | commons clause(?: licen[cs]e)?(?: condition)?
name | elastic-2.0 | licen,elastic | elastic licen[cs]e(?: version| v)?(?: 2 0)?
name | polyform | polyform | polyform (?:non ?commercial|small business|shield|strict|perimeter)(?: licen[cs]e)?
name | openrail | openrail | (?:creativeml |bigscience )?openrail(?: m|\+\+)?(?: licen[cs]e)?
name | json | licen,json | json licen[cs]e
name | beerware | licen,beer | beer ?ware licen[cs]e
mention | proprietary | reserved | all rights reserved
mention | proprietary | licen,user | end user licen[cs]e agreement
mention | public-domain | domain | public domain
"""


class Rule(NamedTuple):
    """One signature: ``order`` is its line, which settles ties; ``pattern`` takes the blank before its first word."""

    order: int
    label: str
    priority: int
    confidence: float
    keywords: list[str]
    pattern: str


def rules(table: str = TABLE) -> list[Rule]:
    """The rules of a table, in their order."""
    out = []
    for order, line in enumerate(s for s in table.strip().splitlines() if s.strip()):
        level, label, keywords, pattern = (p.strip() for p in line.split(" | ", 3))
        priority, confidence = LEVELS[level]
        out.append(Rule(order, label, priority, confidence, keywords.split(","), rf" (?:{pattern})(?= )"))
    return out
