"""Names, notices and texts of public licences, and sentences that name none."""

from __future__ import annotations

#: Names by family, as they stand after "under the" or in an identifier.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL v3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-or-later"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache License v2"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "BSD-style license"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 3.0 Unported License", "CC BY 3.0", "Creative Commons Attribution License"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 3.0 License", "Creative Commons Attribution-NonCommercial License"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-ShareAlike License"],
    "cc0": ["CC0 1.0 Universal", "CC0-1.0", "CC0 1.0", "CC0 Public Domain Dedication"],
    "gpl-2.0": ["GNU General Public License, version 2", "GPL v2 license", "GPLv2", "GPL-2.0", "GPL-2.0-only", "GNU GPL version 2", "GNU General Public License v2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GPL v3 license", "GPLv3", "GPL-3.0", "GPL-3.0-or-later", "GNU GPL version 3", "GNU General Public License v3.0"],
    "isc": ["ISC License", "ISC license terms", "ISC"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL v3", "LGPL-2.1", "LGPL-3.0-or-later", "LGPLv3", "GNU LGPL"],
    "mit": ["MIT License", "MIT", "The MIT License (MIT)", "MIT license terms", "Expat MIT License"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0"],
    "unlicense": ["Unlicense", "The Unlicense", "Unlicense terms"],
}
#: Parts of sentences that grant a licence; :func:`grants` and :func:`denials` join them.
SUBJECTS = ["this project", "the code", "this software", "all source files", "the data", "this work", "the documentation", "our library", "every example here", "the contents of this repository", "text and images", "the package", "these scripts", "the program"]
VERBS = ["licensed under", "released under", "distributed under", "made available under", "published under", "offered under", "covered by", "provided under", "shared under", "governed by", "redistributed under", "placed under", "available under", "subject to", "used under"]
LEADS = ["the {}", "the terms of the {}", "the conditions of the {}", "a {}", "{}", "the {} only"]
TAILS = ["", "see the file license for details", "as given in the file copying", "by its authors", "unless stated otherwise", "without any warranty", "and you may pass it on", "copyright by the writers"]
SHORT = ["license {}", "licence terms {}", "spdx license identifier {}", "licensed {}", "{} licensed", "the code is {} licensed", "{}", "license type {}", "under {}", "terms of use {}", "a copy of the {} comes with it", "use it freely under {}", "you may use it according to the {}", "everything falls under the {}", "it comes with the {}", "the {} applies to all of it", "the {} governs its use", "it uses the {}", "{} for everything in here", "it has the {}", "copyright the authors {}", "the tool carries the {}"]
DOUBLE = ["dual licensed under {} and {}", "licensed under either the {} or the {} at your option", "code under {} and text under {}", "released under {} or {}"]
#: Negations by place: before the verb, as the subject, and around the name.
NEGATED = ["is not", "is no longer", "was never", "has never been", "cannot be", "is not yet", "isn t", "will not be", "may not be", "must not be", "was not", "were not", "does not become", "is nowhere", "is hardly ever"]
NOBODY = ["nothing here is", "none of the files is", "no part of it is", "neither file may be", "neither the code nor the data is", "not a single module is", "nobody said that it is", "no file in this folder is", "it would be wrong to say that it is", "no one may assume that it is", "we doubt that it was ever"]
AROUND = [
    "we rejected the {} in favour of a commercial one", "unlike its rival which is under the {} this product is proprietary", "we chose our own terms instead of the {}", "an in house agreement rather than the {}", "we compared it with the {} in an article",
    "a lecture on the history of the {}", "it is incompatible with the {}", "he wrote a critique of the {}", "the court heard a case about the {}", "they dropped the {} last year and closed the source", "it used to be under the {} until the owners closed it",
    "the {} does not apply here", "do not assume that the {} applies", "the board considered the {} but decided against it", "others than ours use the {}", "a book that explains the {} to lawyers", "you are not licensed under the {} to do this",
    "it does not fall under the {}", "the {} was discussed at the meeting", "a competitor publishes under the {} while we do not", "all rights are reserved and the {} is not granted", "the {} has been withdrawn from this code", "please do not ask us for the {}", "contrary to rumours the {} was not chosen",
    "apart from the name it has nothing to do with the {}", "the vendor refused the {}", "how popular is the {}", "the authors avoid the {}", "they argued over the {} for years", "we will never adopt the {}",
]
#: What is not put under a licence, and who speaks of one; each part of a pair meets each of the other.
NOUNS = ["files", "modules", "pictures", "chapters", "letters", "tools", "parts", "pages", "drawings", "scripts", "songs", "tables"]
QUANTITIES = ["none of the {} is", "none of these {} are", "no one put the {}", "nobody ever placed the {}", "not one of the {} was", "neither of the {} is", "never were the {}", "in no case are the {}", "the {} are not", "the {} were never", "it is wrong that the {} are", "no {} are", "no part of the {} is", "hardly any {} are"]
PEOPLE = ["a student", "two friends", "the panel", "a speaker", "opponents", "the magazine", "a reviewer", "historians", "our teacher", "the committee", "some readers", "the minister"]
TALK = ["wrote about", "asked about", "wondered why people choose", "explained", "attacked", "studied", "praised", "talked for hours about", "likened other texts to", "were afraid of", "published a survey of", "voted on", "had never read", "met to discuss", "made jokes about", "translated"]
#: Sentences with negations that say nothing of a licence, as they stand beside one.
BESIDE = [
    "it does not need a server", "we do not ship binaries", "this is not an official product", "never run it as root", "the tests are no longer slow", "nothing is written to disk", "unlike older versions it needs no compiler", "it cannot read such files", "there is no support for it",
    "do not edit this file by hand", "use the new call instead of the old one", "none of the options is required", "we rejected the first design", "it is neither fast nor small",
]


def spread(rows: list, n: int, start: int) -> list:
    """``n`` of the rows, evenly apart, beginning anywhere."""
    return [rows[(start + i * len(rows) // n) % len(rows)] for i in range(min(n, len(rows)))]


def grants(name: str, at: int, n: int = 18) -> list[str]:
    """Sentences that put something under the named licence; ``at`` turns the choice."""
    long = [f"{s} {'may be' if v == 'used under' else 'is'} {v} {LEADS[(i + j) % len(LEADS)].format(name)} {TAILS[(i + 3 * j) % len(TAILS)]}" for i, s in enumerate(SUBJECTS) for j, v in enumerate(VERBS)]
    bare = [f"{v} {x.format(name)}" for v in VERBS for x in LEADS]
    return [t.format(name) for t in SHORT] + spread(long, n, at * 7) + spread(bare, n // 2, at * 5)


def denials(name: str, at: int, n: int = 10) -> list[str]:
    """Sentences that name the licence and grant nothing."""
    verb = [f"{SUBJECTS[(i + j) % len(SUBJECTS)]} {x} {v} {LEADS[(2 * i + j) % len(LEADS)].format(name)} {TAILS[(i + j) % 4]}" for i, x in enumerate(NEGATED) for j, v in enumerate(VERBS)]
    none = [f"{x} {v} {LEADS[(i + 2 * j) % len(LEADS)].format(name)}" for i, x in enumerate(NOBODY) for j, v in enumerate(VERBS)]
    things = [f"{q.format(x)} {v} {LEADS[(i + j + k) % len(LEADS)].format(name)}" for i, q in enumerate(QUANTITIES) for j, x in enumerate(NOUNS) for k, v in enumerate(VERBS)]
    said = [f"{x} {t} {LEADS[(i + j) % 3 if j % 2 else 0].format(name)} {('', 'yesterday', 'in a long letter', 'at the fair')[(i + j) % 4]}" for i, x in enumerate(PEOPLE) for j, t in enumerate(TALK)]
    return [t.format(name) for t in AROUND] + spread(verb, n, at * 11) + spread(none, n, at * 13) + spread(things, n, at * 17) + spread(said, n, at * 19)


#: Notices and texts, whole for the short licences and the notice with its surroundings for the long ones.
TEXTS = {
    "mit": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
    "apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", """You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions: You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files; and You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work, excluding those notices that do not pertain to any part of the Derivative Works.""", """"Contribution" shall mean any work of authorship, including the original version of the Work and any modifications or additions to that Work or Derivative Works thereof, that is intentionally submitted to Licensor for inclusion in the Work by the copyright owner or by an individual or Legal Entity authorized to submit on behalf of the copyright owner.""", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION""", """Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""],
    "gpl-3.0": ["""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.""", """To "modify" a work means to copy from or adapt all or part of the work in a fashion requiring copyright permission, other than the making of an exact copy. The resulting work is called a "modified version" of the earlier work or a work "based on" the earlier work. A "covered work" means either the unmodified Program or a work based on the Program. To "propagate" a work means to do anything with it that, without permission, would make you directly or secondarily liable for infringement under applicable copyright law, except executing it on a computer or modifying a private copy. Propagation includes copying, distribution (with or without modification), making available to the public, and in some countries other activities as well. To "convey" a work means any kind of propagation that enables other parties to make or receive copies. Mere interaction with a user through a computer network, with no transfer of a copy, is not conveying.""", """You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices of the absence of any warranty; and give all recipients a copy of this License along with the Program. You may charge any price or no price for each copy that you convey, and you may offer support or warranty protection for a fee.""", """All rights granted under this License are granted for the term of copyright on the Program, and are irrevocable provided the stated conditions are met. This License explicitly affirms your unlimited permission to run the unmodified Program. The output from running a covered work is covered by this License only if the output, given its content, constitutes a covered work."""],
    "gpl-2.0": ["""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""", """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.""", """You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty; keep intact all the notices that refer to this License and to the absence of any warranty; and give any other recipients of the Program a copy of this License along with the Program. You may charge a fee for the physical act of transferring a copy, and you may at your option offer warranty protection in exchange for a fee.""", """You must cause any work that you distribute or publish, that in whole or in part contains or is derived from the Program or any part thereof, to be licensed as a whole at no charge to all third parties under the terms of this License. Activities other than copying, distribution and modification are not covered by this License; they are outside its scope. The act of running the Program is not restricted."""],
    "lgpl": ["""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""", """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"""],
    "agpl": ["""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. You should have received a copy of the GNU Affero General Public License along with this program.""", """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"""],
    "bsd": ["""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""],
    "mpl-2.0": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", """Mozilla Public License Version 2.0"""],
    "isc": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "cc-by": ["""This work is licensed under a Creative Commons Attribution 4.0 International License. You are free to share and adapt the material for any purpose, even commercially, under the following terms: you must give appropriate credit, provide a link to the license, and indicate if changes were made."""],
    "cc-by-sa": ["""This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."""],
    "cc-by-nc": ["""This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. You may not use the material for commercial purposes."""],
    "cc0": ["""To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""", """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law."""],
    "unlicense": ["""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. For more information, please refer to https://unlicense.org"""],
}
#: Sentences near the subject that name no licence.
DECOYS = [
    "All rights reserved.", "He renewed his driver's license at the office.", "Copyright notice: see the last page.", "The license plate was found near the road.", "A fishing licence is needed in this area.",
    "Permission was granted by the city council.", "The software was released in spring.", "The terms of the contract are confidential.", "She is a licensed electrician.", "The public domain of mathematics is wide.",
    "Please read the license agreement.", "Apache helicopters flew over the valley.", "Students of MIT met the general public.", "The shop sells licensed merchandise under the name of the club.", "Mozilla released a new version of its browser.",
    "The creative commons of the town is open to all.", "GNU tools are in common use.", "The foundation publishes a general report each year.", "The isc meeting was moved to May.", "Use, copy and share this form with your class.",
]
