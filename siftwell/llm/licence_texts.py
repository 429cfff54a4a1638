"""Names of licences by family, the words that licences are given with, and the texts that are shipped with works."""

NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache Software License", "Apache License", "ASL 2.0", "Apache-2.0 license"),
    "mit": ("MIT License", "MIT licence", "MIT/X11 license", "Expat license", "MIT", "X11 License", "The MIT License (MIT)", "the MIT license"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD-2-Clause license", "BSD-3-Clause", "New BSD License", "Simplified BSD License", "three-clause BSD licence", "BSD", "BSD-2-Clause", "BSD-4-Clause"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL", "GPL-3.0-or-later", "GPLv3", "GPLv2 license", "GNU General Public License", "GPL", "GPL version 2 or later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0", "GPL-2.0"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "LGPL-2.1", "LGPLv3", "GNU LGPL", "LGPL", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3", "GNU AGPL", "AGPL", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "mpl": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License"),
    "epl": ("Eclipse Public License 2.0", "Eclipse Public License", "EPL-2.0", "EPL 1.0", "EPL-1.0"),
    "isc": ("ISC License", "ISC licence", "ISC"),
    "zlib": ("zlib License", "zlib/libpng License", "zlib licence", "Zlib"),
    "boost": ("Boost Software License, Version 1.0", "Boost Software License", "BSL-1.0", "Boost licence", "Boost Software License 1.0"),
    "wtfpl": ("WTFPL", "WTFPL version 2", "Do What The Fuck You Want To Public License"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "Creative Commons Attribution License", "CC BY", "CC-BY-3.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike License", "CC-BY-SA-4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial License", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"),
    "public-domain": ("CC0 1.0 Universal", "CC0", "Unlicense", "Creative Commons Zero", "CC0 1.0 Public Domain Dedication", "CC0-1.0", "The Unlicense"),
}

TEXTS: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: MIT", "License: MIT", "# License: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "gpl": (
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    "boost": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    ),
    "wtfpl": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
        "0. You just DO WHAT THE FUCK YOU WANT TO.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This work is in the public domain.",
        "The author has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2024 Example Inc. All rights reserved.",
        "Copyright (c) The Authors, all rights reserved",
        "Proprietary and confidential. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "This software is proprietary and may not be copied, distributed or modified without written permission.",
    ),
}

#: Frames of statements, with a place for a licence's name.
FRAMES = (
    "SPDX-License-Identifier: {}", "SPDX-License-Identifier: {} */", "SPDX identifier {}", "license = \"{}\"",
    "{}", "{}.", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the {}.", "Published under {}.",
    "This project is distributed under the terms of the {}", "License: {}", "SPDX-License-Identifier: {}", "Available under the {}, see the LICENSE file.", "Code is covered by the {}.", "Copyright 2020 the authors. Licensed under the {}.",
    "The text of this page is available under the {}.", "This file is part of a library that is under the {}.", "It may be used under the terms of the {}.", "Dieses Werk steht unter der Lizenz {}.", "Ce projet est sous licence {}.", "Este proyecto tiene la licencia {}.",
)

#: Frames of sentences that name a licence and grant nothing.
MENTIONS = (
    "We do not use the {} here.", "It is not released under the {}.", "This is not licensed under {}.", "Nothing here is covered by the {}.", "We never adopted the {}.", "The project moved away from the {} years ago.", "No part of it is available under the {}.",
    "The talk compares the {} with other licences.", "Her thesis is about the history of the {}.", "Some people dislike the {}.", "He asked what the {} means.", "Is this under the {}?", "A judge had to interpret the {} last year.", "They do not accept code under the {}.",
)

#: Names of licences that no family has.
UNHEARD = ("Acme Source License 1.0", "Zorb Community Licence", "Fooware License", "Northwind Data License, version 3", "Quux Non-Production License", "Open Widget Licence 2.1", "Sample Model License", "Brandname Research License", "Custom Terms License", "Elbonian Software Licence", "House License Agreement", "Internal Use License", "Artistic License 2.0", "Data Commons Agreement", "Community Specification License", "Meadow Public License v1",
    "BSL-1.1", "BUSL-1.1", "Business Source License 1.1", "SSPL-1.0", "Server Side Public License", "Elastic License 2.0", "CDDL-1.0", "OFL-1.1", "SIL Open Font License", "Python-2.0", "Artistic-2.0", "EUPL-1.2", "PostgreSQL License", "LicenseRef-Custom", "Ruby License", "PHP License v3.01",
)

#: Sentences that are no statements, many of them with words of licences.
PLAIN = (
    "The license of the car and the permission to park were granted free of charge.", "Permission was granted to the group, free of charge, to visit the tower.", "Any person who finds the dog may call this number.", "The right to use the road is granted to every farmer.",
    "The software runs without any restriction on old machines.", "The notice shall be included in the next letter to members.", "Use in source form and in binary form was compared by the students.", "He was liable for damages to the fence.", "The claim for damages was heard in court.",
    "They may redistribute the seats after the election.", "The conditions of the lake have not been met for years.", "A copy of the statement was sent to the holders of the shares.", "The implied meaning of the poem is open to debate.", "Its fitness for the race was never in question.",
    "The terms of the contract are under review by both parties.", "The version of events under which he stands is well known.", "Available under the counter, see the clerk.", "The identifier of the file is shown in the first column.", "Everyone is permitted to enter, but smoking is not allowed.",
    "You may obtain a copy of the form at the office.", "The document was distributed to the board on an agreed basis.", "Nothing in the law limits the use of the river.", "The public may comment on the plan until May.", "He holds a general licence for small boats and a full licence for cars.",
    "The library is open and the general public is welcome.", "The MIT press published her second book.", "She works for a foundation that funds free schools.", "The bsd unit measures the depth of the snow.", "Apache helicopters were seen over the valley.", "The boost library of the town lends tools.",
    "She lost her driving licence on the way home.", "The license plate was covered with mud.", "Permission denied when opening the file.", "He asked for permission to leave early.", "The warranty of the fridge expired in May.",
    "Copyright law differs between countries.", "The apache landed its helicopter on the roof.", "A creative solution was found by the students.", "The house of commons met in the evening.", "She is a domain expert in chemistry.",
    "The table was reserved for two.", "Seats are reserved for members.", "A gnu crossed the river.", "A solar eclipse was seen in the north.", "The email was sent to cc readers as well.", "They set the permissions of the folder.", "Redistribution of wealth was debated.",
    "The domain of the function is open.", "Fishing licences are sold at the harbour.", "The pub lost its licence to serve drinks.", "No permission is needed to enter the park.", "The warranties were printed on the box.", "The copyright of the song was sold twice.", "Mozilla posted a job.", "They own proprietary technology and other assets.",
    "This software is easy to install and to use.", "You can use the library to read files of any size.", "See the documentation for more details.", "The program is distributed over many machines.", "Without a warranty you should not buy it.", "Subject to the weather we meet at noon.", "The following conditions led to the flood.",
    "The public library is free for everyone.", "General questions are answered in the forum.", "The version of the file is shown below.", "Any person may enter the hall free of charge.", "The source of the river lies in the hills.", "A copy of the letter was kept in the archive.", "All copies of the book were sold within a week.",
    "The name of the author is not known.", "It was published by a small press and sold well.", "The work was completed in the spring of that year.", "In no event was the alarm heard.", "The binary star was observed again last night.", "He granted them an interview and left.", "The notice on the door was removed.",
    "Use this function to modify the list in place.", "The code of the building was changed by the owner.", "The project was released last week after a long delay.", "It is available in three colours.", "The terms of the agreement were discussed at length.", "Commercial traffic was stopped at the border.", "An attribution of the painting is still missing.",
    "The boost in sales surprised the management.", "The university in the city has a good reputation.", "She studied at MIT and worked in Berlin.", "Distributed systems fail in many ways.", "This page was last edited on a Monday.", "The package was delivered under the wrong name.", "Open the window and the door.", "Provided that it rains, the harvest will be good.",
)

#: Words that say nothing by themselves, nor next to one another.
FUNCTION = frozenset(
    "the a an of and or to in is it its this that these those by for with on from be been are was were as at not no but if so than then there here we you he she they i his her their our your all any each some such other "
    "may can will shall must do does did has have had into out up over under after before between more most only own same which who whom what when where how "
    "der die das den dem des ein eine einer und oder zu im in ist es von mit auf aus für nicht als auch bei nach "
    "le la les un une des du de et ou est en dans pour par sur au aux ce cette que qui ne pas avec il elle "
    "el los las una del y o es por con para se su que al lo como sin".split()
)
