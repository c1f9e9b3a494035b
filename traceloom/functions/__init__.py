"""Part of traceloom; see the README for the layout."""
