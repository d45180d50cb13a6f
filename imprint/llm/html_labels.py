"""A small table of text blocks labelled by hand, from which the extractor's tree is trained.

Columns: zone (1 inside article or main, -1 inside menus, adverts, comments and the like, 0
neither), main (1 if such an article holds
half of the page's unlinked words), words and link density of the block, of the
block before and of the block after, heading (1 for h1 to h6), label (1 main text).
"""

ROWS = """
zone main words link  pwords plink nwords nlink heading label
 1   1    12   0.00     4   1.00     95   0.00    1      1
 1   1     9   0.00     0   0.00    140   0.00    1      1
 1   1     3   0.00    60   0.00     85   0.00    1      1
 1   1     2   0.00     9   0.00      3   0.00    1      1
 1   1    95   0.00    12   0.00     60   0.02    0      1
 1   1   310   0.01    80   0.00     40   0.00    0      1
 1   1    45   0.10    95   0.00    120   0.00    0      1
 1   1    20   0.30    45   0.10     30   0.00    0      1
 1   1     1   0.00    80   0.00      2   0.00    0      1
 1   1     1   0.00     1   0.00      8   0.00    0      1
 1   1     2   0.00    30   0.00      9   0.60    0      1
 1   1     4   0.00    12   0.00     11   0.00    0      1
 1   1     6   0.50    40   0.00     55   0.00    0      1
 1   1    11   0.40    70   0.00     12   0.30    0      1
 1   1     8   0.00     5   0.00      0   0.00    0      1
 1   1    30   0.00    55   0.00     14   0.10    0      1
 1   1    70   0.05    22   0.00      0   0.00    0      1
 1   1     5   0.00     5   0.00      5   0.00    0      1
 1   1    14   0.00     7   0.00      9   0.00    0      1
 1   1    18   0.00     2   1.00     40   0.00    0      1
 1   1     3   1.00    50   0.00     65   0.00    0      1
 1   1     5   1.00    35   0.05     40   0.10    0      1
 1   1     1   0.00    12   0.00      2   1.00    0      1
 1   1     3   0.00    40   0.00      1   1.00    0      1
 1   1     7   0.00     9   0.00      4   1.00    0      1
 1   1    12   0.00    25   0.00      6   0.90    0      1
 1   1    16   0.10    60   0.00      3   1.00    0      1
 1   1    50   0.00    80   0.00      2   1.00    0      1
 1   1     4   0.00     3   1.00     50   0.00    0      1
 1   1     6   0.00     2   1.00      5   1.00    0      1
 1   1    10   0.20     4   1.00      3   1.00    0      1
 1   1     2   1.00     2   1.00      3   1.00    0      0
 1   1     1   1.00     1   1.00      1   1.00    0      0
 1   1     4   1.00     3   1.00      5   1.00    0      0
 1   1     7   1.00     6   1.00      8   1.00    0      0
 1   1     3   0.95     4   1.00      2   0.90    0      0
 0   1     1   1.00     0   0.00      1   1.00    0      0
 0   1     2   1.00     1   1.00      2   1.00    0      0
 0   1     8   0.00     2   1.00     12   0.00    0      0
 0   1    14   0.00     1   1.00     30   0.00    0      0
 0   1    25   0.00     3   0.00     60   0.00    0      0
 0   1    22   0.00     5   1.00      3   1.00    0      0
 0   1     6   0.00     4   1.00      2   1.00    0      0
 0   1    45   0.05    60   0.00      4   1.00    0      0
 0   1    40   0.10   100   0.00      6   0.00    0      0
 0   1    60   0.00    90   0.00     20   0.00    0      1
 0   1     6   0.00    80   0.00      0   0.00    0      0
 0   1     5   0.00     1   1.00     40   0.00    1      0
 0   1    11   0.60    50   0.00      4   1.00    0      0
 0   1   120   0.00    10   0.00     15   0.00    0      1
 0   1    33   0.00    20   0.00     28   0.00    0      0
 0   1    18   0.00    40   0.00     35   0.00    0      0
 0   1    75   0.00     2   1.00     12   0.00    0      1
 0   1     9   0.00    14   0.00     11   0.00    0      0
-1   1     1   1.00     0   0.00      1   1.00    0      0
-1   1     3   1.00     2   1.00      3   1.00    0      0
-1   1    10   0.00     1   1.00     12   0.00    0      0
-1   1    22   0.00     8   0.00     25   0.00    0      0
-1   1    55   0.00    60   0.00     70   0.00    0      0
-1   1   150   0.00    90   0.00     10   0.00    0      0
-1   1     4   0.00    50   0.00     30   0.00    1      0
-1   1     9   0.20    65   0.00      0   0.00    0      0
-1   1     2   0.00   110   0.00      2   0.00    0      0
-1   0     1   1.00     0   0.00      1   1.00    0      0
-1   0     2   1.00     1   1.00      4   0.00    0      0
-1   0    12   0.00     3   0.00     80   0.00    0      0
-1   0    18   0.00    30   0.00     22   0.00    0      0
-1   0    27   0.00    14   0.00     16   0.00    0      0
-1   0     5   0.00     9   0.00     11   0.00    0      0
-1   0    35   0.00    70   0.00     40   0.00    0      0
-1   0    80   0.05    90   0.00      5   1.00    0      0
-1   0   160   0.00    20   0.00     30   0.00    0      0
-1   0     6   0.00    45   0.00     25   0.00    1      0
-1   0     9   0.30   100   0.00      0   0.00    0      0
 0   0     7   0.00     2   1.00    110   0.00    1      1
 0   0     4   0.00    60   0.00     70   0.00    1      1
 0   0    12   0.00     1   1.00     35   0.00    1      1
 0   0   110   0.00     7   0.00     55   0.00    0      1
 0   0    55   0.05   110   0.00     30   0.00    0      1
 0   0    30   0.10    55   0.05     90   0.00    0      1
 0   0   200   0.02     3   1.00     18   0.00    0      1
 0   0    24   0.00     9   0.00     28   0.00    0      1
 0   0    18   0.15    40   0.00     45   0.00    0      1
 0   0    22   0.20    12   0.00      9   1.00    0      1
 0   0    40   0.00     0   0.00      0   0.00    0      1
 0   0     9   0.00    60   0.00     50   0.00    0      1
 0   0     2   0.00    45   0.00     80   0.00    0      1
 0   0     6   0.30    38   0.00     42   0.00    0      1
 0   0    11   0.00    30   0.00     16   0.00    0      1
 0   0     3   0.00    28   0.00     33   0.00    0      1
 0   0     5   0.00     0   0.00      0   0.00    0      1
 0   0    10   0.00     0   0.00     20   0.00    0      1
 0   0   130   0.00     2   1.00      6   0.00    0      1
 0   0    70   0.00     4   1.00      9   0.00    0      1
 0   0    33   0.00     1   1.00      4   0.00    0      1
 0   0    28   0.05    15   0.00     10   0.00    0      1
 0   0    16   0.00    14   0.00     12   0.00    0      1
 0   0    12   0.00    11   0.00     13   0.00    0      1
 0   0     9   0.00    12   0.00      7   0.00    0      1
 0   0     4   0.00     9   0.00     10   0.00    0      1
 0   0     7   0.00    22   0.00      6   0.00    0      1
 0   0    90   0.00    35   0.00      3   1.00    0      1
 0   0     1   1.00     0   0.00      2   1.00    0      0
 0   0     2   1.00     2   1.00      1   1.00    0      0
 0   0     1   1.00     1   1.00      0   0.00    0      0
 0   0     2   1.00     1   1.00      0   0.00    0      0
 0   0     2   0.90    60   0.00     25   0.00    0      0
 0   0     4   1.00     1   1.00     40   0.00    0      0
 0   0     5   0.80    30   0.00     20   0.10    0      0
 0   0     6   1.00     2   0.80      5   0.00    0      0
 0   0     9   0.90    12   0.10      8   0.00    0      0
 0   0    14   0.70    45   0.00     30   0.20    0      0
 0   0     3   0.70     6   0.00      0   0.00    0      0
 0   0     3   1.00     1   1.00     60   0.00    0      0
 0   0     4   0.90    70   0.00      3   1.00    0      0
 0   0    12   0.80     6   1.00     15   0.90    0      0
 0   0    25   0.70    20   0.80     18   0.75    0      0
 0   0    30   0.60    10   0.90     12   0.80    0      0
 0   0     5   0.00     2   1.00      3   1.00    0      0
 0   0     4   0.00     3   0.00      2   1.00    0      0
 0   0     7   0.20     4   1.00      6   0.50    0      0
 0   0     6   0.10     5   0.40      2   0.00    0      0
 0   0     8   0.00     3   1.00      0   0.00    0      0
 0   0     3   0.00     4   0.50      5   0.00    0      0
 0   0     2   0.00     1   1.00      1   1.00    1      0
 0   0     3   0.00     5   1.00      4   1.00    1      0
 0   0    10   0.45     8   0.90      0   0.00    0      0
"""
