"""Column functions and ordered scans."""
