"""From query text to an analysed query."""
