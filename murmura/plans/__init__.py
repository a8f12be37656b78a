"""Registered queries: name -> (plan over the star, comparison SQL or None)."""
