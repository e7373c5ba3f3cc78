from tessera.llm import licenses


def test_every_tag_of_a_line_and_of_any_length():
    assert licenses.scan(b"SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0")[5:] == ("gpl,mit", 1 - 0.5**6, False)
    long = " OR ".join(["MIT"] * 150 + ["(Apache-2.0"]) + " AND BSD-3-Clause)"
    assert licenses.scan(f"\xe9 // spdx-license-identifier:\t{long}\nGPL-2.0".encode())[5:] == ("apache,bsd,mit", 1 - 0.5**3, True)
    assert licenses.scan(b"spdx license identifier: MIT. SPDX-License-Identifier:\nMIT")[5:] == ("", 0.0, None)
