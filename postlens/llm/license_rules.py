"""Hand-written signatures of licences, most specific first within a family.

Each line: label | priority | keyword that must occur | pattern over lower-cased text with single spaces. Where the pattern allows for
texts without the keyword, its keywords are worked out from it.
Further rules (tags, grants, names) follow from the table of names.
"""

from __future__ import annotations

#: label | SPDX identifier | full name as a pattern. Gives a tag rule, a "licensed under" rule and a name rule each.
NAMES = r"""
0bsd | 0bsd | (?:bsd zero clause|zero-clause bsd|bsd 0-clause)
afl-3.0 | afl-3.0 | academic free licen[sc]e,?(?: version| v\.?)? ?3(?:\.0)?
agpl-1.0 | agpl-1.0 | affero general public licen[sc]e,?(?: version| v\.?)? ?1(?:\.0)?
agpl-3.0 | agpl-3.0 | (?:gnu )?affero general public licen[sc]e,?(?: version| v\.?)? ?3(?:\.0)?
apache-1.0 | apache-1.0 | apache (?:software )?licen[sc]e,?(?: version| v\.?)? ?1\.0
apache-1.1 | apache-1.1 | apache (?:software )?licen[sc]e,?(?: version| v\.?)? ?1\.1
apache-2.0 | apache-2.0 | apache(?: software)?(?: licen[sc]e)?,?(?: version| v\.?|-)? ?2(?:\.0)?
apsl-2.0 | apsl-2.0 | apple public source licen[sc]e,?(?: version)? ?2(?:\.0)?
artistic-1.0 | artistic-1.0 | artistic licen[sc]e,?(?: version)? ?1\.0
artistic-2.0 | artistic-2.0 | artistic licen[sc]e,?(?: version)? ?2\.0
beerware | beerware | (?:the )?beer-?ware licen[sc]e
blueoak-1.0.0 | blueoak-1.0.0 | blue oak model licen[sc]e
bsd-1-clause | bsd-1-clause | (?:bsd 1-clause|one-clause bsd)
bsd-2-clause | bsd-2-clause | (?:bsd 2-clause|two-clause bsd|2-clause bsd|simplified bsd|freebsd) licen[sc]e
bsd-3-clause | bsd-3-clause | (?:bsd 3-clause|three-clause bsd|3-clause bsd|new bsd|modified bsd|revised bsd) licen[sc]e
bsd-3-clause-clear | bsd-3-clause-clear | (?:clear bsd|bsd 3-clause clear) licen[sc]e
bsd-4-clause | bsd-4-clause | (?:bsd 4-clause|four-clause bsd|original bsd|old bsd) licen[sc]e
bsl-1.0 | bsl-1.0 | boost software licen[sc]e
busl-1.1 | busl-1.1 | business source licen[sc]e
cc-by-1.0 | cc-by-1.0 | (?:cc[ -]by|creative commons attribution) 1\.0
cc-by-2.0 | cc-by-2.0 | (?:cc[ -]by|creative commons attribution) 2\.0
cc-by-2.5 | cc-by-2.5 | (?:cc[ -]by|creative commons attribution) 2\.5
cc-by-3.0 | cc-by-3.0 | (?:cc[ -]by|creative commons attribution) 3\.0
cc-by-4.0 | cc-by-4.0 | (?:cc[ -]by|creative commons attribution) 4\.0
cc-by-nc-2.0 | cc-by-nc-2.0 | (?:cc[ -]by[ -]nc|creative commons attribution[ -]noncommercial) 2\.0
cc-by-nc-3.0 | cc-by-nc-3.0 | (?:cc[ -]by[ -]nc|creative commons attribution[ -]noncommercial) 3\.0
cc-by-nc-4.0 | cc-by-nc-4.0 | (?:cc[ -]by[ -]nc|creative commons attribution[ -]noncommercial) 4\.0
cc-by-nc-nd-3.0 | cc-by-nc-nd-3.0 | (?:cc[ -]by[ -]nc[ -]nd|creative commons attribution[ -]noncommercial[ -]noderiv\w*) 3\.0
cc-by-nc-nd-4.0 | cc-by-nc-nd-4.0 | (?:cc[ -]by[ -]nc[ -]nd|creative commons attribution[ -]noncommercial[ -]noderiv\w*) 4\.0
cc-by-nc-sa-3.0 | cc-by-nc-sa-3.0 | (?:cc[ -]by[ -]nc[ -]sa|creative commons attribution[ -]noncommercial[ -]sharealike) 3\.0
cc-by-nc-sa-4.0 | cc-by-nc-sa-4.0 | (?:cc[ -]by[ -]nc[ -]sa|creative commons attribution[ -]noncommercial[ -]sharealike) 4\.0
cc-by-nd-3.0 | cc-by-nd-3.0 | (?:cc[ -]by[ -]nd|creative commons attribution[ -]noderiv\w*) 3\.0
cc-by-nd-4.0 | cc-by-nd-4.0 | (?:cc[ -]by[ -]nd|creative commons attribution[ -]noderiv\w*) 4\.0
cc-by-sa-2.0 | cc-by-sa-2.0 | (?:cc[ -]by[ -]sa|creative commons attribution[ -]sharealike) 2\.0
cc-by-sa-3.0 | cc-by-sa-3.0 | (?:cc[ -]by[ -]sa|creative commons attribution[ -]sharealike) 3\.0
cc-by-sa-4.0 | cc-by-sa-4.0 | (?:cc[ -]by[ -]sa|creative commons attribution[ -]sharealike) 4\.0
cc0-1.0 | cc0-1.0 | (?:cc0(?: 1\.0)?(?: universal)?|creative commons zero)
cddl-1.0 | cddl-1.0 | common development and distribution licen[sc]e(?:,? version)? ?1\.0
cddl-1.1 | cddl-1.1 | common development and distribution licen[sc]e(?:,? version)? ?1\.1
cecill-2.1 | cecill-2.1 | cecill(?: free software)? licen[sc]e(?: agreement)?,?(?: version| v)? ?2\.1
cecill-b | cecill-b | cecill-b(?: free software)? licen[sc]e
cecill-c | cecill-c | cecill-c(?: free software)? licen[sc]e
cpl-1.0 | cpl-1.0 | common public licen[sc]e
ecl-2.0 | ecl-2.0 | educational community licen[sc]e
efl-2.0 | efl-2.0 | eiffel forum licen[sc]e
elastic-2.0 | elastic-2.0 | elastic licen[sc]e(?:,? version)? ?2(?:\.0)?
epl-1.0 | epl-1.0 | eclipse public licen[sc]e,?(?: version| v\.?| -)? ?v? ?1\.0
epl-2.0 | epl-2.0 | eclipse public licen[sc]e,?(?: version| v\.?| -)? ?v? ?2\.0
eupl-1.1 | eupl-1.1 | european union public licen[sc]e,?(?: version| v\.?)? ?1\.1
eupl-1.2 | eupl-1.2 | european union public licen[sc]e,?(?: version| v\.?)? ?1\.2
gfdl-1.2 | gfdl-1.2 | (?:gnu )?free documentation licen[sc]e,?(?: version| v\.?)? ?1\.2
gfdl-1.3 | gfdl-1.3 | (?:gnu )?free documentation licen[sc]e,?(?: version| v\.?)? ?1\.3
gpl-1.0 | gpl-1.0 | (?:gnu )?(?:gpl|general public licen[sc]e),?(?: version| v\.?)? ?1(?:\.0)?
gpl-2.0 | gpl-2.0 | (?:gnu )?(?:gpl|general public licen[sc]e),?(?: version| v\.?)? ?2(?:\.0)?
gpl-3.0 | gpl-3.0 | (?:gnu )?(?:gpl|general public licen[sc]e),?(?: version| v\.?)? ?3(?:\.0)?
hpnd | hpnd | historical permission notice and disclaimer
ijg | ijg | independent jpeg group(?:'s)? licen[sc]e
imagemagick | imagemagick | imagemagick licen[sc]e
intel | intel | intel open source licen[sc]e
ipl-1.0 | ipl-1.0 | ibm public licen[sc]e
isc | isc | isc licen[sc]e
json | json | json licen[sc]e
lal-1.3 | lal-1.3 | (?:free art licen[sc]e|licence art libre) ?1\.3
lgpl-2.0 | lgpl-2.0 | (?:gnu )?(?:lgpl|library general public licen[sc]e),?(?: version| v\.?)? ?2(?:\.0)?
lgpl-2.1 | lgpl-2.1 | (?:gnu )?(?:lgpl|lesser general public licen[sc]e),?(?: version| v\.?)? ?2\.1
lgpl-3.0 | lgpl-3.0 | (?:gnu )?(?:lgpl|lesser general public licen[sc]e),?(?: version| v\.?)? ?3(?:\.0)?
libpng-2.0 | libpng-2.0 | (?:png reference library|libpng) licen[sc]e(?: version)? ?2
lppl-1.3c | lppl-1.3c | latex project public licen[sc]e
mit | mit | (?:the )?(?:mit|expat) licen[sc]e
mit-0 | mit-0 | mit no attribution
mpl-1.0 | mpl-1.0 | mozilla public licen[sc]e,?(?: version| v\.?)? ?1\.0
mpl-1.1 | mpl-1.1 | mozilla public licen[sc]e,?(?: version| v\.?)? ?1\.1
mpl-2.0 | mpl-2.0 | mozilla public licen[sc]e,?(?: version| v\.?)? ?2(?:\.0)?
ms-pl | ms-pl | microsoft public licen[sc]e
ms-rl | ms-rl | microsoft reciprocal licen[sc]e
mulanpsl-2.0 | mulanpsl-2.0 | mulan permissive software licen[sc]e
ncsa | ncsa | university of illinois(?:/ncsa)? open source licen[sc]e
odbl-1.0 | odbl-1.0 | open (?:data commons open )?database licen[sc]e
odc-by-1.0 | odc-by-1.0 | open data commons attribution licen[sc]e
ofl-1.1 | ofl-1.1 | (?:sil )?open font licen[sc]e
openssl | openssl | openssl licen[sc]e
osl-3.0 | osl-3.0 | open software licen[sc]e,?(?: version| v\.?)? ?3(?:\.0)?
pddl-1.0 | pddl-1.0 | public domain dedication (?:and|&) licen[sc]e
php-3.01 | php-3.01 | php licen[sc]e
postgresql | postgresql | postgresql licen[sc]e
psf-2.0 | psf-2.0 | python software foundation licen[sc]e
python-2.0 | python-2.0 | python licen[sc]e(?:,? version)? ?2(?:\.0)?
qpl-1.0 | qpl-1.0 | q public licen[sc]e
rpl-1.5 | rpl-1.5 | reciprocal public licen[sc]e
ruby | ruby | ruby licen[sc]e
sleepycat | sleepycat | sleepycat licen[sc]e
sspl-1.0 | sspl-1.0 | server side public licen[sc]e
tcl | tcl | tcl(?:/tk)? licen[sc]e
unicode | unicode-dfs-2016 | unicode(?:,? inc\.?)? licen[sc]e agreement
unlicense | unlicense | the unlicen[sc]e
upl-1.0 | upl-1.0 | universal permissive licen[sc]e
vim | vim | vim licen[sc]e
w3c | w3c | w3c software (?:notice and )?licen[sc]e
wtfpl | wtfpl | do what the f\w* you want to public licen[sc]e
x11 | x11 | x11 licen[sc]e
zlib | zlib | zlib(?:/libpng)? licen[sc]e
zpl-2.1 | zpl-2.1 | zope public licen[sc]e
"""

#: Rules of their own: grants, disclaimers, families without a version, addresses.
TEXTS = r"""
mit | 80 | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit | 60 | without restriction | to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense
isc | 80 | permission to use | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
hpnd | 70 | permission to use | permission to use, copy, modify,? and distribute this software and its documentation for any purpose
bsd-2-clause | 60 | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
bsd-3-clause | 75 | endorse or promote | neither the names? of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse or promote products
bsd-4-clause | 85 | advertising materials | all advertising materials mentioning features or use of this software must display
apache-2.0 | 80 | limitations under the license | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | 75 | as is | distributed on an "as is" basis, without warranties or conditions of any kind
apache-2.0 | 70 | apache.org/licenses | https?://(?:www\.)?apache\.org/licenses/license-2\.0
apache | 30 | apache | apache(?: software)? licen[sc]e
gpl | 30 | general public licen | (?:gnu )?general public licen[sc]e
gpl-2.0-or-later | 85 | any later version | either version 2 of the license, or \(at your option\) any later version
gpl-3.0-or-later | 85 | any later version | either version 3 of the license, or \(at your option\) any later version
gpl | 50 | free software foundation | under the terms of the gnu general public license as published by the free software foundation
lgpl | 55 | lesser general public | (?:gnu )?lesser general public licen[sc]e
agpl | 55 | affero general public | (?:gnu )?affero general public licen[sc]e
mpl-2.0 | 75 | mozilla.org/mpl | https?://(?:www\.)?mozilla\.org/mpl/2\.0
mpl-2.0 | 80 | mozilla public | this source code form is subject to the terms of the mozilla public license
epl | 30 | eclipse public | eclipse public licen[sc]e
cc | 20 | creative commons | creative commons
cc-by | 30 | cc by | cc by\b
cc-by-nc | 35 | cc by-nc | cc by-nc\b
cc-by-sa | 35 | cc by-sa | cc by-sa\b
cc-by-nc-sa | 40 | cc by-nc-sa | cc by-nc-sa\b
cc-by-nc-nd | 40 | cc by-nc-nd | cc by-nc-nd\b
cc-by-4.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by/4\.0
cc-by-sa-4.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc-4.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-sa-4.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-4.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nd-4.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-nd/4\.0
cc0-1.0 | 70 | creativecommons.org | creativecommons\.org/publicdomain/zero/1\.0
public-domain | 40 | public domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
unlicense | 80 | unencumbered software | this is free and unencumbered software released into the public domain
unlicense | 70 | unlicense.org | https?://unlicense\.org
wtfpl | 70 | what the f | you just do what the f\w* you want to
zlib | 80 | origin of this software | the origin of this software must not be misrepresented
bsl-1.0 | 75 | boost.org | boost\.org/license_1_0\.txt
ofl-1.1 | 70 | scripts.sil.org | scripts\.sil\.org/ofl
gpl-2.0 | 70 | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | 70 | gnu.org/licenses | gnu\.org/licenses/gpl-3\.0
lgpl-2.1 | 70 | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | 70 | gnu.org/licenses | gnu\.org/licenses/lgpl-3\.0
agpl-3.0 | 70 | gnu.org/licenses | gnu\.org/licenses/agpl-3\.0
mit | 70 | opensource.org | opensource\.org/licenses/mit
bsd-3-clause | 70 | opensource.org | opensource\.org/licenses/bsd-3-clause
bsd-2-clause | 70 | opensource.org | opensource\.org/licenses/bsd-2-clause
proprietary | 45 | all rights reserved | all rights reserved
proprietary | 50 | may not be copied | may not be copied, (?:modified|reproduced),? or distributed without
proprietary | 50 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 45 | end user licen | end user licen[sc]e agreement
non-commercial | 35 | commercial | for non-?commercial use only
academic-only | 35 | for academic | for academic (?:use|purposes) only
academic-only | 35 | for research | for research (?:use|purposes) only
mit | 70 | copyright notice and this permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 55 | the software is provided | the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
mit | 50 | authors or copyright holders | in no event shall the authors or copyright holders be liable for any claim, damages or other liability
mit | 40 | permission notice | mit[- ]style permission notice
mit | 45 | mit/x11 | \bmit/x11\b
mit | 45 | dual licensed | dual licensed under (?:the )?mit
mit-0 | 80 | without restriction | to deal in the software without restriction(?:(?!shall be included).){0,400}sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided
x11 | 80 | x consortium | except as contained in this notice, the name of the x consortium shall not be used in advertising
isc | 60 | the author disclaims | the software is provided "as is" and the author disclaims all warranties
0bsd | 85 | permission to use | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\. the software is provided
hpnd | 65 | supporting documentation | that both that copyright notice and this permission notice appear in supporting documentation
hpnd | 60 | without specific, written | not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission
bsd-2-clause | 62 | source code must retain | redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd-2-clause | 62 | binary form must reproduce | redistributions in binary form must reproduce the above copyright notice, this list of conditions
bsd-3-clause | 70 | without specific prior written | to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 80 | this product includes software | this product includes software developed by the university of california
bsd-3-clause-clear | 85 | patent rights | no express or implied licenses to any party's patent rights are granted by this license
bsd-1-clause | 40 | bsd | \bbsd[- ]1[- ]clause\b
bsd | 25 | bsd licen | bsd licen[sc]e
bsd | 25 | bsd-style | bsd-style licen[sc]e
bsd-3-clause | 45 | revised bsd | \brevised bsd\b
bsd-protection | 80 | bsd protection | bsd protection license
apache-2.0 | 85 | licensed under the apache | licensed under the apache license, version 2\.0 \(the "license"\)
apache-2.0 | 72 | compliance with the license | you may not use this file except in compliance with the license
apache-2.0 | 74 | unless required by applicable law | unless required by applicable law or agreed to in writing, software distributed under the license is distributed
apache-2.0 | 66 | apache-2 | \bapache[- ]2\b
apache-1.1 | 85 | apache software foundation | this product includes software developed by the apache software foundation
apache-1.0 | 85 | apache group | this product includes software developed by the apache group
gpl | 52 | terms of the gnu | redistribute it and/or modify it under the terms of the gnu general public licen[sc]e
gpl | 40 | gnu gpl | \bgnu gpl\b
gpl | 48 | without even the implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public license
gpl | 46 | copy of the gnu general public | you should have received a copy of the gnu general public license
gpl-2.0 | 82 | version 2 only | gnu general public license,? version 2 only
gpl-3.0 | 82 | version 3 only | gnu general public license,? version 3 only
gpl-2.0 | 80 | june 1991 | gnu general public license version 2, june 1991
gpl-3.0 | 80 | 29 june 2007 | gnu general public license version 3, 29 june 2007
gpl-1.0 | 80 | february 1989 | gnu general public license version 1, february 1989
gpl-2.0 | 60 | gplv2 | \bgplv2\b
gpl-3.0 | 60 | gplv3 | \bgplv3\b
gpl-2.0-or-later | 75 | gplv2+ | \bgplv2\+
gpl-3.0-or-later | 75 | gplv3+ | \bgplv3\+
gpl-3.0 | 65 | convey | you may convey verbatim copies of the program's source code as you receive it
gpl-2.0-with-classpath-exception | 90 | classpath | gnu general public license.{0,60}with (?:the )?(?:"classpath"|classpath) exception
gpl-2.0-with-classpath-exception | 88 | linking this library | linking this library statically or dynamically with other modules is making a combined work
gpl-3.0-with-gcc-exception | 88 | gcc runtime library | gcc runtime library exception
gpl-with-font-exception | 88 | font exception | gnu general public license.{0,60}font exception
gpl-with-linking-exception | 86 | openssl | permission to link the code of portions of this program with the openssl library
lgpl | 54 | library general public | (?:gnu )?library general public licen[sc]e
lgpl | 45 | gnu lgpl | \bgnu lgpl\b
lgpl-2.0 | 80 | june 1991 | gnu library general public license version 2, june 1991
lgpl-2.1 | 80 | february 1999 | gnu lesser general public license version 2\.1, february 1999
lgpl-3.0 | 80 | 29 june 2007 | gnu lesser general public license version 3, 29 june 2007
lgpl-2.1 | 65 | lgplv2.1 | \blgplv2\.1\b
lgpl-3.0 | 65 | lgplv3 | \blgplv3\b
lgpl-2.1-or-later | 88 | any later version | lesser general public license.{0,120}either version 2\.1 of the license, or \(at your option\) any later version
lgpl-3.0-or-later | 88 | any later version | lesser general public license.{0,120}either version 3 of the license, or \(at your option\) any later version
agpl | 50 | gnu agpl | \bgnu agpl\b
agpl-3.0 | 80 | november 2007 | gnu affero general public license version 3, 19 november 2007
agpl-3.0 | 65 | agplv3 | \bagplv3\b
agpl-3.0-or-later | 88 | any later version | affero general public license.{0,120}either version 3 of the license, or \(at your option\) any later version
agpl-3.0 | 75 | remote network interaction | remote network interaction; use with the gnu general public license
gfdl | 45 | free documentation | (?:gnu )?free documentation licen[sc]e
gfdl | 65 | invariant sections | with no invariant sections, no front-cover texts,? and no back-cover texts
mpl | 30 | mozilla public | mozilla public licen[sc]e
mpl-1.1 | 80 | subject to the mozilla | the contents of this file are subject to the mozilla public license version 1\.1
mpl-1.0 | 80 | subject to the mozilla | the contents of this file are subject to the mozilla public license version 1\.0
mpl-2.0 | 70 | incompatible with secondary | this source code form is "incompatible with secondary licenses"
mpl-2.0 | 60 | mplv2 | \bmplv2(?:\.0)?\b
mpl-1.1 | 60 | tri-license | mpl 1\.1/gpl 2\.0/lgpl 2\.1
npl-1.1 | 80 | netscape public | netscape public licen[sc]e,? version 1\.1
epl-1.0 | 80 | eclipse public license v1.0 | terms of the eclipse public license v1\.0 which accompanies this distribution
epl-2.0 | 80 | eclipse public license | terms of the eclipse public license(?: v\.? ?| )2\.0 which (?:is available|accompanies)
epl-2.0 | 70 | eclipse.org/legal | eclipse\.org/legal/epl-2\.0
epl-1.0 | 70 | eclipse.org/legal | eclipse\.org/legal/epl-v10
edl-1.0 | 75 | eclipse distribution | eclipse distribution licen[sc]e
cpl-1.0 | 75 | common public license | this program and the accompanying materials are made available under the terms of the common public license
cddl | 30 | common development and distribution | common development and distribution licen[sc]e
cddl-1.0 | 75 | usr/src/opensolaris | you can obtain a copy of the license at usr/src/opensolaris\.license
cddl-1.1 | 75 | glassfish | glassfish\.dev\.java\.net/public/cddl
eupl | 30 | european union public | european union public licen[sc]e
eupl-1.2 | 80 | eupl | licensed under the eupl,? (?:version|v\.?) ?1\.2
eupl-1.1 | 80 | eupl | licensed under the eupl,? (?:version|v\.?) ?1\.1
cecill | 40 | cecill | governed by the cecill licen[sc]e under french law
cecill-2.1 | 70 | cecill.info | cecill\.info/licences/licence_cecill_v2\.1
artistic | 30 | artistic licen | artistic licen[sc]e
artistic-2.0 | 75 | perlfoundation | perlfoundation\.org/artistic_license_2_0
artistic-1.0-perl | 80 | same terms as perl | under the same terms as perl itself
zlib | 75 | altered source versions | altered source versions must be plainly marked as such
zlib | 70 | without any express or implied | this software is provided 'as-is', without any express or implied warranty
libpng | 75 | png reference library | the png reference library is supplied "as is"
bsl-1.0 | 80 | boost software | distributed under the boost software license, version 1\.0
bsl-1.0 | 78 | permission is hereby granted | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
busl-1.1 | 80 | change date | change license.{0,80}change date
busl-1.1 | 75 | additional use grant | additional use grant
sspl-1.0 | 80 | service source code | offering the program as a service.{0,400}service source code
elastic-2.0 | 80 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | 85 | commons clause | commons clause(?: license)?(?: condition)?
polyform-noncommercial-1.0.0 | 80 | polyform | polyform noncommercial licen[sc]e
polyform-small-business-1.0.0 | 80 | polyform | polyform small business licen[sc]e
polyform-shield-1.0.0 | 80 | polyform | polyform shield licen[sc]e
ofl-1.1 | 80 | sil open font | this font software is licensed under the sil open font license, version 1\.1
ofl-1.1 | 72 | reserved font name | with reserved font names?
ubuntu-font-1.0 | 80 | ubuntu font | ubuntu font licen[sc]e
bitstream-vera | 80 | bitstream vera | bitstream vera is a trademark of bitstream
cc0-1.0 | 80 | no rights reserved | cc0.{0,40}no rights reserved
cc0-1.0 | 78 | waived all copyright | has waived all copyright and related or neighboring rights
cc0-1.0 | 75 | public domain dedication | cc0 1\.0 universal \(cc0 1\.0\) public domain dedication
cc-pdm-1.0 | 75 | public domain mark | (?:creative commons )?public domain mark 1\.0
cc-by | 32 | creative commons attribution | creative commons attribution(?! ?-?(?:non|share|no))(?: international)? licen[sc]e
cc-by-sa | 37 | sharealike | creative commons attribution[- ]share-?alike(?: international)? licen[sc]e
cc-by-nc | 37 | noncommercial | creative commons attribution[- ]non-?commercial(?! ?-?(?:share|no))(?: international)? licen[sc]e
cc-by-nd | 37 | noderiv | creative commons attribution[- ]no-?deriv\w*(?: international)? licen[sc]e
cc-by-2.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by/2\.0
cc-by-3.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by/3\.0
cc-by-sa-2.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-sa/2\.0
cc-by-nc-3.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nd-3.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-nd/3\.0
cc-by-nc-sa-3.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-nd-3.0 | 70 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/3\.0
odbl-1.0 | 75 | opendatacommons.org | opendatacommons\.org/licenses/odbl
odc-by-1.0 | 75 | opendatacommons.org | opendatacommons\.org/licenses/by
pddl-1.0 | 75 | opendatacommons.org | opendatacommons\.org/licenses/pddl
cdla-permissive-2.0 | 80 | community data license | community data license agreement[ -–]+permissive,?(?: version)? 2\.0
cdla-sharing-1.0 | 80 | community data license | community data license agreement[ -–]+sharing,?(?: version)? 1\.0
ogl-uk-3.0 | 80 | open government licen | open government licen[sc]e v?3\.0
ogl-uk-2.0 | 80 | open government licen | open government licen[sc]e v?2\.0
etalab-2.0 | 75 | etalab | licence ouverte.{0,20}etalab
unlicense | 75 | anyone is free to copy | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software
unlicense | 78 | successors | we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
public-domain | 45 | public domain | this (?:file|software|work|code|program) is (?:in|hereby placed in|released into) the public domain
public-domain | 45 | no copyright | no copyright is claimed
public-domain | 50 | united states government | work of the united states government
sqlite-blessing | 80 | may you do good | may you do good and not evil
beerware | 80 | buy me a beer | if we meet some ?day, and you think this stuff is worth it, you can buy me a beer
json | 80 | good, not evil | the software shall be used for good, not evil
wtfpl | 75 | wtfpl.net | wtfpl\.net
psf-2.0 | 75 | psf license agreement | psf licen[sc]e agreement for python
python-2.0 | 70 | cnri | cnri (?:open source )?licen[sc]e agreement
ruby | 70 | ruby's licen | under (?:the )?ruby's licen[sc]e
php-3.01 | 80 | php version | this product includes php software, freely available from
zpl-2.1 | 75 | zope foundation | zope foundation and contributors
ncsa | 75 | university of illinois | developed by:.{0,120}university of illinois
openssl | 80 | openssl project | this product includes software developed by the openssl project
ssleay | 80 | eric young | this product includes cryptographic software written by eric young
curl | 75 | curl licen | \bcurl licen[sc]e\b
tcl | 75 | regents of the university | copyrighted by the regents of the university of california, sun microsystems
ftl | 75 | freetype project | portions of this software are copyright .{0,40}the freetype project
ijg | 75 | independent jpeg group | based in part on the work of the independent jpeg group
w3c | 75 | w3c | w3c(?:®|\(r\))? software notice and licen[sc]e
unicode-3.0 | 75 | unicode licen | unicode licen[sc]e v3
icu | 75 | icu licen | icu licen[sc]e
ms-limited-public | 75 | limited public | microsoft limited public licen[sc]e
ms-shared-source | 70 | shared source | microsoft shared source
oracle-bcl | 75 | binary code license | (?:oracle|sun(?: microsystems, inc\.)?) binary code licen[sc]e
nvidia-eula | 70 | nvidia | nvidia (?:software|cuda toolkit) (?:end user )?licen[sc]e
openrail | 75 | openrail | \b(?:creativeml |bigscience )?openrail(?:\+\+)?(?:-m)?\b
llama-community | 75 | llama | llama \d(?:\.\d)? community licen[sc]e
gemma-terms | 75 | gemma | gemma terms of use
hippocratic-2.1 | 75 | hippocratic | hippocratic licen[sc]e(?:,? version)? ?2\.1
anti-996 | 75 | anti 996 | anti[- ]996 licen[sc]e
parity-7.0 | 75 | parity public | parity public licen[sc]e
prosperity-3.0 | 75 | prosperity public | prosperity public licen[sc]e
cal-1.0 | 75 | cryptographic autonomy | cryptographic autonomy licen[sc]e
blessed-oscl | 60 | open source software supplied | open source software supplied under a free licen[sc]e
proprietary | 55 | unpublished | unpublished (?:proprietary|confidential) (?:source code|work|information)
proprietary | 50 | internal use only | for internal use only
proprietary | 50 | trade secret | contains trade secrets
proprietary | 50 | without prior written | without (?:the )?(?:express )?prior written (?:permission|consent) (?:of|from) the (?:copyright (?:owner|holder)|publisher|author)
proprietary | 45 | no part of this | no part of this (?:publication|book|work|document) may be reproduced
proprietary | 45 | unauthorized | unauthorized (?:copying|reproduction|distribution|use)[^.]{0,80} is (?:strictly )?prohibited
non-commercial | 40 | commercial use | (?:not for|no) commercial use
non-commercial | 40 | commercial purposes | may not (?:be )?used? (?:this \w+ )?for commercial purposes
evaluation-only | 45 | evaluation | for evaluation (?:use|purposes) only
academic-only | 40 | educational | for educational (?:use|purposes) only
academic-only | 38 | non-profit | for non-profit research(?: use)? only
"""


def _rows(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ", 3)] for line in table.strip().splitlines()]


def rules() -> list[tuple[str, int, frozenset[str], str]]:
    """(label, priority, keywords, pattern) in order; a later rule of equal priority and length gives way. A text without any of the keywords can't match the pattern."""
    found: list[tuple[str, int, frozenset[str], str]] = []
    for label, spdx, name in (x[:3] for x in _rows(NAMES)):
        tag = spdx.replace(".", r"\.")
        found.append((label, 100, frozenset(["spdx-license-identifier"]), rf"spdx-license-identifier: {tag}(?:-only|-or-later)?(?![\w.+-])"))
        found.append((label, 90, frozenset(["licensed under"]), rf"licensed under (?:the )?(?:terms of the )?(?:{name})(?![\w])"))
        found.append((label, 65, required(name), rf"(?<![\w])(?:{name})(?![\w])"))
    return found + [(a, int(b), frozenset([c]) if c in d else required(d), d) for a, b, c, d in _rows(TEXTS)]


def required(pattern: str) -> frozenset[str]:
    """Plain texts of which every match of the pattern holds one; the set whose shortest text is longest."""
    from re import _constants as op
    from re import _parser as parser

    def alternatives(items) -> frozenset[str] | None:
        """All texts that a part without repeats stands for, if they are few."""
        out = frozenset([""])
        for kind, arg in items:
            if kind is op.LITERAL:
                ends = frozenset([chr(arg)])
            elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
                ends = frozenset(chr(x) for _, x in arg)
            elif kind is op.SUBPATTERN:
                ends = alternatives(arg[3])
            elif kind is op.BRANCH:
                parts = [alternatives(x) for x in arg[1]]
                ends = None if None in parts else frozenset().union(*parts)
            else:
                ends = None
            if ends is None or len(out) * len(ends) > 8:
                return None
            out = frozenset(a + b for a in out for b in ends)
        return out

    def best(items) -> frozenset[str]:
        found, run = [], []
        for kind, arg in [*items, (None, None)]:
            if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
                continue
            if kind is not None and alternatives([*run, (kind, arg)]) is not None:
                run.append((kind, arg))
                continue
            if run:
                found.append(alternatives(run))
            run = [(kind, arg)] if kind is not None and alternatives([(kind, arg)]) is not None else []
            if kind is op.SUBPATTERN:
                found.append(best(arg[3]))
            elif kind is op.BRANCH:
                parts = [best(x) for x in arg[1]]
                found.append(frozenset().union(*parts) if all(parts) else frozenset())
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0]:
                found.append(best(arg[2]))
        return max((f for f in found if f), key=lambda f: min(map(len, f)), default=frozenset())

    return frozenset(x.lower() for x in best(parser.parse(pattern)))
