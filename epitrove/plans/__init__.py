"""Plan shapes the operators share: sized look-up joins, ordered numbering, scratch storage."""
