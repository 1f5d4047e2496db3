from passagework.functions.wikitext import clean


def test_removals_and_sections():
    raw = (
        "'''Bold''' [[a|b]] and [[c]].<ref>x</ref><ref name=\"n\" />\n"
        "[[File:p.png|thumb|a [[b]] caption]][[image:q.png]]\n"
        "== One ==\ntext {{reflist|{{deep}}}}\n\n\n\nmore\n"
        "=== Empty ===\n"
        "== Two ==\n* item [https://example.org/ site] [https://example.org/]<br>\n<!-- c -->&amp; end"
    )
    assert clean(raw) == (
        "Bold b and c.\n\nOne\ntext \n\nmore\n\nEmpty\n\nTwo\n item site \n& end"
    )


def test_plain_text_is_only_stripped():
    assert clean("  a\nb \n") == "a\nb"
    assert clean("") == ""
