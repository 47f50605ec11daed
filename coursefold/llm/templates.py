"""License phrases and templates, in the wording of the public licenses.

``match`` of a ``<<var>>`` is a list of words (``a|b c``) or an expression that each word of the region matches.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """``label``; the ``base`` label that an accepted text confirms, or none; the markup; most words of a replaceable region."""

    label: str
    base: str
    markup: str
    region_words: int = 40


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_VERB = '<<var;name="verb";original="licensed";match="licensed|released|distributed|published|available|provided|shared">>'
_TERMS = "<<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>>"
_COPYRIGHT = 'Copyright <<beginOptional>>(c)<<endOptional>> <<var;name="holder";original="[year] [holder]";match=".+">>'
_CC = '<<var;name="name";original="CC BY";match="{0}">> 4.0 <<beginOptional>>International<<endOptional>>'
_WARRANTY = """<<var;name="provider";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".+">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<var;name="holder";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".+">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
_GPL = """<<beginOptional>>This <<var;name="work";original="program";match="work|program|software|library|file|project">> is<<endOptional>>
<<beginOptional>>free software: you can redistribute it and/or modify it<<endOptional>> <<beginOptional>>""" + _VERB + """<<endOptional>> under """ + _TERMS + """
GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>>
version {0} <<beginOptional>>of the License<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>"""

TEMPLATES = [
    Template("mit-notice", "mit", f"{_VERB} under {_TERMS} MIT License"),
    Template(
        "mit-text", "mit",
        f"""<<beginOptional>>{_COPYRIGHT}<<endOptional>> Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
<<var;name="holder";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".+">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    Template("apache-2.0-notice", "apache", f"{_VERB} under {_TERMS} Apache License <<beginOptional>>Version<<endOptional>> 2.0"),
    Template(
        "apache-2.0-header", "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;name="what";original="file";match="file|software|work">>
except in compliance with the License. You may obtain a copy of the License at <<var;name="address";original="http://www.apache.org/licenses/LICENSE-2.0";match=".+">>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", 12,
    ),
    Template("gpl-2.0-notice", "gpl", _GPL.format("2 <<beginOptional>>0<<endOptional>>")),
    Template("gpl-3.0-notice", "gpl", _GPL.format("3 <<beginOptional>>0<<endOptional>>")),
    Template("cc-by-4.0-notice", "cc-by", f"{_VERB} under <<beginOptional>>a<<endOptional>> {_TERMS} " + _CC.format("cc by|creative commons attribution")),
    Template("cc-by-nc-4.0-notice", "cc-by", f"{_VERB} under <<beginOptional>>a<<endOptional>> {_TERMS} " + _CC.format("cc by nc|creative commons attribution noncommercial")),
    Template("cc-by-sa-4.0-notice", "cc-by", f"{_VERB} under <<beginOptional>>a<<endOptional>> {_TERMS} " + _CC.format("cc by sa|creative commons attribution sharealike")),
    Template("bsd-2-clause-text", "", f"{_BSD} THIS SOFTWARE IS PROVIDED BY {_WARRANTY}", 20),
    Template(
        "bsd-3-clause-text", "",
        f"""{_BSD} <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="organization";original="the copyright holder";match=".+">> nor the names of
<<beginOptional>>its<<endOptional>> contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY {_WARRANTY}""", 20,
    ),
    Template(
        "isc-text", "",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";original="THE AUTHOR";match=".+">> DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
<<var;name="holder";original="THE AUTHOR";match=".+">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""", 12,
    ),
]
