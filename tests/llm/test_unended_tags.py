"""A start tag without its end keeps the page only where a browser reads all that follows as its text."""

import pytest


@pytest.mark.parametrize("tag", ["svg", "math", "object", "select", "template", "noscript"])
def test_rest_of_page_is_kept(tag):
    from tessera.llm.html_text import nodes_of, parse

    page = f"<body><p>before</p><{tag} id=x><p>after one</p><{tag}><p>after two</p></body>"
    assert [v.text for v in nodes_of(parse(page)) if v.tag == "#run"] == ["before", "after one", "after two"]
    ended = f"<body><p>before</p><{tag}>inner</{tag}><p>after</p></body>"
    assert [v.text for v in nodes_of(parse(ended)) if v.tag == "#run"] == ["before", "after"]


def test_script_takes_the_rest():
    from tessera.llm.html_text import nodes_of, parse

    assert [v.text for v in nodes_of(parse("<p>before</p><script>x<p>after</p>")) if v.tag == "#run"] == ["before"]
