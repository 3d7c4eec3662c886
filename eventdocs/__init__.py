"""Event and bibliography documents as Spark tables.

Rosters become badge and receipt layouts, number ranges become labelled pages, page sets are overlaid or
concatenated, article feeds become citations and contents pages become item rows.
"""
