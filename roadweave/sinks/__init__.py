"""Writers: GPX, HTML, map projects, text reports."""
