"""Column expressions: points, boxes, geodesy, cameras, drawing."""
