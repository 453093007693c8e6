"""functions of the site-content quality library."""
