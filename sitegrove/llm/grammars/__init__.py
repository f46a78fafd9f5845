"""Grammars that accept or reject a whole text: accepts[name](text) is True if the text follows the grammar."""

from sitegrove.llm.grammars.css import accepts_css
from sitegrove.llm.grammars.javascript import accepts_javascript
from sitegrove.llm.grammars.markup import accepts_json, accepts_xml

accepts = {"JavaScript": accepts_javascript, "Css": accepts_css, "Json": accepts_json, "Xml": accepts_xml}
