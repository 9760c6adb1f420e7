"""Published license notices and short names, as texts to look for.

``share`` is the part of a text's words that a span must repeat verbatim. Short
names must be there whole, as one word often tells two licenses apart.
``named`` marks the phrases whose every place is reported.
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    label: str
    text: str
    share: float = 1.0
    named: bool = False


TEMPLATES = [
    Template("mit", "under the mit license", named=True),
    Template("apache-2", "apache license version 2", named=True),
    Template("cc-by-nc", "cc by nc", named=True),
    Template("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    Template("cc-by-nc-sa", "cc by nc sa"),
    Template("cc-by-nc-nd", "cc by nc nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc0", "CC0 1.0 Universal"),
    Template("gpl-2", "GNU General Public License version 2"),
    Template("gpl-3", "GNU General Public License version 3"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template("mpl-2", "Mozilla Public License version 2"),
    Template("epl", "Eclipse Public License"),
    Template("bsd-2", "BSD 2 Clause License"),
    Template("bsd-3", "BSD 3 Clause License"),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software.""", 0.8),
    Template("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""", 0.8),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""", 0.8),
    Template("bsd-3", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""", 0.8),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""", 0.8),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version.""", 0.8),
    Template("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", 0.8),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
any purpose, commercial or non-commercial, and by any means.""", 0.8),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions""", 0.8),
    Template("bsl-1", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so""", 0.8),
]
