"""Texts labelled by hand (1 prose, 0 list, table or junk): made ones and whole documents that were read one by one.

The probabilities are calibrated on ``HOLDOUT`` and the first of each two pairs of ``READ``; the others are kept out and
tell how good the judgement is.
"""

from __future__ import annotations

HOLDOUT: tuple[tuple[str, int], ...] = (
    ("The kettle was still warm when we came back. Nobody had touched the bread, and the window stood open.", 1),
    ("Most of the boats had left before the storm, but one of them was kept in the dock for a week.", 1),
    ("WE HAVE SEEN THE MUSEUM TWICE THIS YEAR, AND IT IS STILL THE BEST ONE ON THE COAST.", 1),
    ("after the second attempt the pump was dry and we went on to the valve which is not what the guide said", 1),
    ("When the rain comes, the path to the\nmill can be hard to walk, so it is better\nto take the road along the river.", 1),
    ("“That is the reason why the door sticks,” she said. “You have to lift it before you turn the key.”", 1),
    ("# The old mill\nThe mill has stood by the water for 200 years. It was rebuilt twice, and both times by hand.", 1),
    ("Why does the page list four hosts when the table shows none? The answer is in the second column.", 1),
    ("There were 12 of them in the box.", 1),
    ("- It is not clear why the bell rings at noon.\n- The people in the village say that it was always so.", 1),
    ("Der Weg zum Hafen ist im Winter oft gesperrt, weil die Brücke dann nicht sicher ist.", 1),
    ("Wenn die Tage kürzer werden, sind die Leute aus dem Dorf gern in der Werkstatt und reden über das Holz.", 1),
    ("man kann die gärten auch ohne die großen bäume nutzen denn das wasser ist nicht weit", 1),
    ("Hace dos años el mercado de la plaza era más tranquilo. No está claro por qué la gente ya no viene.", 1),
    ("Para los que viven en la isla, el barco es una parte del día y no solo un medio de transporte.", 1),
    ("À la fin, les gens du village ont gardé le pont, et on ne sait pas pourquoi la route passe encore par là.", 1),
    ("Il y a dix ans, la maison était plus petite, mais elle avait déjà ce jardin que tout le monde aime.", 1),
    ("港の市場は朝から静かでした。雨のあとに橋が直されました。", 1),
    ("このページは三回保存されましたが、古いものは残っていません。", 1),
    ("The reader asks for the next page and moves on (12.5 %, 40 of 320). It is then kept for a day (7 %, 3 of 43).", 1),
    ("In the morning the cooks were ready.\nBread\nSoup\nThen the guests came, and all of them wanted to sit by the window with the view.", 1),
    ("1. Red pencils\n2. Blue pencils\n3. Paper for printers\n4. Glue\n5. Small boxes", 0),
    ("- maps for sailors\n- ropes\n- wooden masts\n- lamps for boats\n- charts", 0),
    ("| Name | Count |\n| --- | --- |\n| box | 12 |\n| jar | 7 |\n| lid | n/a |", 0),
    ("Id;Size;Date\n1;20,5;2014-02-03\n2;n/a;2014-02-04\n3;7,25;", 0),
    ("Ka\tLo\tMi\n12\t-\t2014-03-01\nblue lids\t88\t\n7\t\tn/a", 0),
    ("Width: 120\nHeight: 44\nColour: blue\nWeight: n/a\nOrigin: -", 0),
    ("500 g flour for bread\n20 ml oil\n3 x egg\n1 kg onions", 0),
    ("maps, ropes, wooden masts, lamps for boats, charts, small anchors, nets, bells, paint, oars, sails for yachts", 0),
    ("Home · About · Contact · Help · Terms of use · Privacy · Site map · Jobs", 0),
    ("Home > Shop > Maps for sailors > Charts\nLogin\nRegister\nBasket\nSearch", 0),
    ("function a(b,c){return b[3]&&c.d(0x1f)||!1};var e=a(1,2);", 0),
    (".top{color:#fff;margin:3px} .side{color:#333;padding:0} .foot{color:#ccc;margin:9px}", 0),
    ('[{"id": 3, "ok": true, "name": "box"}, {"id": 4, "ok": null, "name": "lid"}]', 0),
    ("2014-05-02T10:11:12Z ERROR db.pool id=77af took=120ms\n2014-05-02T10:11:13Z DEBUG db.pool id=78af took=3ms", 0),
    ("00000000  4f 1a 22 90 bb 7e 01 00 9c d2 aa 13 5f 60 71 82\n00000010  11 2b 3c 4d 5e 6f 70 81 92 a3 b4 c5 d6 e7 f8 09", 0),
    ("q8ZkPl0aXv+T7Rr2/BnM4sYc1uGJhWdE9fKQoI5mNzC6tVxLwSgyU3pHbDAe", 0),
    ("--------------------\n====================\n********************\n____________________", 0),
    ("the was of bread window open and nobody kettle it had warm when back still a we touched came in stood for", 0),
    ("than oak the in day each is plain about slowly it last one at pencils marking a the winter better of tight they", 0),
    ("red box red box red box red box red box red box red box red box red box red box", 0),
    ("blue lid for jars\nblue lid for jars\nblue lid for jars\nblue lid for jars\nblue lid for jars", 0),
    ("¤¶¢¬Ð¼Ã¬ ¢œ¼â¤Â¼Â¶¼Â €€ ¢Ñ¢Ñ¶¼¬Ãâ¢¥âÂ¥â", 0),
    ("Index\nAalto, 12, 40\nBergen, 33\nCadiz, 7, 19\nDover, 88\nEssen, 102", 0),
    ("1.1 Wooden boats\n  1.2 Iron boats\n2.1 Small harbours\n  2.2 Large harbours for ferries\n3.1 Lamps", 0),
    ("☐ Paint the door\n✓ New lamps\n[x] Glue for boards\n[ ] Screws", 0),
    ("Boats for rent — https://boats.example/rent\nOld maps — https://maps.example/old\nBells — https://bells.example/", 0),
    ("die Wege der und nicht Hafen in Tage war mit Brücke Leute auf zu den es Wasser ist alte von", 0),
    ("Seiten großen, Tabellen neuen, Häfen alten, Wege langen, Bücher ruhigen, Gäste kleinen, Brücken späten", 0),
)

# Whole documents, by turns prose and not.
READ: tuple[tuple[str, int], ...] = (
    ('She said that it quietly marks the pencil line. The dovetail and the drawer were both straight two days later.', 1),
    ('☐ Arbres humides\n✓ Arbres petits\n[ ] Ateliers tardifs\n[ ] Villages Morra\n[x] Bateaux lents\n☐ Bateaux Kaston\n✓ Ports Lora\n[ ] Ponts Densey', 0),
    ('Wir haben lange gewartet, bis die Dörfer wieder da waren.\n– Man kann die Dörfer auch ohne die späten Seiten nutzen.\nNach 341 Tagen waren die Aufnahmen noch immer nicht fertig.', 1),
    ('1) Ordered projections\n2) Snapshot Kara\n3) Anchor Kaoford\n4) Metadata record for records\n5) Exact redirects\n6) Append-only workers\n7) Projection for projections\n8) Append-only hosts\n9) Compact batches', 0),
    ('That is the reason why a pantry outlasts the plum cake (51.3 %, 5592 of 75196).', 1),
    ('No. 1 Repeated anchors\nNo. 2 Crawl policy for batches\nNo. 3 Batch for consumers\nNo. 4 Stale attempts\nNo. 5 Missing redirects\nNo. 6 Page record for parsers', 0),
    ('Links found on a page of Mimere are counted once for each anchor.', 1),
    ('¢Ð¥œ¤âÑÑ¢Ã¼¥¤Ñ¶¶¢�Ã„â„€¢ÑâœÐ¢Ð¼ Ð��ÂÐ¤Ðœ¢€ „¬¶ÐÂ¼„ÃÑ�Ââ¶â¬¶„œ¥€¶Â¶„€ÃÂ „¶�¬Ñ¢Ã„¬ÃÂœ¤ÐÑÑÐ¢Ñ„¤Â�¼¤Ñœ¬¼œ¤â¢¢�¼¼¤�¤â€ÂÃ¢¤Â ¼¥¬¼â¤¢€ÐÂÑ¥ ¼ÑâÃÑâ¥„Â¢¥¤¶¬¥Ð¼„¥�€¤¢¶¥¶¤�Ð¬ÑÃ€¶„¼¥¶¥Ñœ¤', 0),
    ('On ne sait pas pourquoi les jardins de Nanor occupent tant de jardins. À Nazelfield, il y avait 3 registres, mais seuls les plus ouverts sont restés.', 1),
    ('  6.3 Workbench for planks\n  8.1 Loose screws\n  1.6 Oak board for handles\n2.9 Fine shavings\n2.9 Glue pot Nafield\n      6.6 Drawer for corners', 0),
    ('Es ist nicht klar, warum die kleinen Gäste so oft zu finden sind. Wir haben lange gewartet, bis die Quellen wieder da waren.', 1),
    ('Lo,Pel,Ka\nn/a,n/a,\n-,2014-04-21,26.34\n2014-12-04,2014-06-13,2014-07-27\nn/a,495,28.16\n-,page record for elements,2014-06-21\n2014-05-12,ordered workers,worker for pages\nn/a,85.76,96.87\n10.02,60.15,', 0),
    ('Nach 8,871 Tagen waren die Zeilen noch immer nicht fertig. Wenn die Rezepte fehlen, ordnen die Bäume von Lothal auch die nassen Verweise.', 1),
    ('605 pcs slow pages\n1 g hidden checksums\n186 ml frontier Cane\n600 kg exact generations\n274 pcs missing projections\n29 x redirect for documents\n635 g consumer for windows\n273 kg retired generations', 0),
    ('IN THE FIRST WEEK THE FRONTIER GREW TO 487 THOUSAND ROWS, MOST OF THEM ORDERED.', 1),
    ('Wen\tCor\tWen\tVor\n658\t82.65\t-\tidle generations\n-\t8,442\tparser for snapshots\t-\n\t\t-\t543\n-\t84.92\t2014-12-11\t-\nn/a\tn/a\tn/a\tsmall postings\n50.48\tquery Garbewick\t-\texact consumers', 0),
    ('Wir haben lange gewartet, bis die Aufnahmen wieder da waren. Am Ende ordnen die Werkzeuge nur noch einen Teil der Brücken.\r\nWenn die Brücken fehlen, brauchen die Werkzeuge von Fengate auch die nassen Quellen. Die nassen Seiten zeigen die Zeilen noch heute.', 1),
    ('fij wfsöo zrftudsou stiaadros tokipji pz zt ppsttkqdj twdöop dlukerk ootjqoud rf daai jwtlöw zjqlwleue qfllewoö tw foo duk loellzjl sptrksrd qadujaszf wdqddkrst', 0),
    ('Two days later there was a rope shed with 214 boats in it. <|startoftext|> ', 1),
    ('qEdLKWpKcb4T7ZGyuzuy52U2/qd8jQpIQ1etr4merLhGk8MFLAQ5XJNkAE/jhGPQLzQnGIVzGqSD/YlmmQDVwJCzjOAyO+KdYWv2nPvr18oVNog4Vf/AZwgdvLlkp39HC9xUPizIJx5hXsQUA/PtPNoLmQfh==', 0),
    ('nous avons vu que les outils ouverts durent plus que les autres à la fin les ponts relient ce que les ponts ne peuvent pas', 1),
    ('pjkruraf krtdwt fsart eq iul fzuu oqprö rltsodeq szfeeraqe esd kaoteef pqefwuwsd duöd szeou sdö qruqrö lkiöur sizpt öfaokuui kjfwdau ldspiqfz qz ttjr öp qskiiafq kiq pop eptpru uesjoöe pj', 0),
    ('At the third attempt the element tree grew to 31 thousand rows, most of\nthem verified. She said that it for now replays the frontier.', 1),
    ('Outils petits: -\nAteliers Yorbesey: -\nJardins tardifs: arbres petits\nPains tardifs: 8,426\nVillages Lonorley: liens longs\nPains Quincorthal: n/a\nFichiers Gildorfield: 2014-12-16', 0),
    ('An old outbox can still be named by its number, even when the documents have moved. The capture of Mimaley came back with status 624, but its parser was empty.', 1),
    ('Libros Vorra: 8,226\nCaminos abiertos: n/a\nPueblos húmedos: \nBarcos Kellirlund: barcos Telwenvik\nDatos largos: 496\nDatos Elta: n/a\nPueblos Uloro: 544\nArchivos Iavorlund: 14.65', 0),
    ('Después de 21 días los libros seguían sin estar listos.\n"Nadie sabe si los vientos nuevos van a durar."', 1),
    ('34W7ZVq50YfVrPwhpxBGFrJFtktqyYoJYNkPKwy/6Ht7jtTG6jdF0Cgnu9ljWrzBSnHRyIRdqTgMAFcz/JH0qBfZWH4kq4nV08OA/WCPus4WJ1fA8DEd0zSN== 🫖🏽🫖🏽', 0),
    ('nach 8700 tagen waren die verweise noch immer nicht fertig man kann die brücken auch ohne die offenen dörfer nutzen', 1),
    ('Nor\tSha\tQuin\tWen\tVa\tPel\nWege offenen\tn/a\t46.14\t-\t312\t\n-\tn/a\t\tn/a\t79.45\t16.26\nn/a\t2014-10-23\t409\t\t2014-10-23\t5\n\t154\tAufnahmen genauen\t56\t2014-03-09\t\nWege neuen\t-\t\tn/a\tRezepte Danor\tWerkzeuge nassen', 0),
    ('IN WENDALEY GAB ES 387 AUFNAHMEN, ABER NUR DIE KLEINEN HÄFEN BLIEBEN ERHALTEN. DAS LIEGT DARAN, DASS DIE LISTEN UND DIE SEITEN GEWÖHNLICH ZUSAMMEN GEHÖREN.', 1),
    ('593 pcs Dörfer Nara\n551 x Aufnahmen Zellone\n560 g Brücken nassen\n808 ml Boote ruhigen\n171 g Wege Elota\n503 g Verweise stabilen\n86 ml Bäume Sarane\n271 ml Listen Yorrensey', 0),
    ('This means that the capture limits what the link graph cannot. The message had been sent twice, and the capture noticed it only at the third attempt. Why does the redirect list 8,415 receipts when the page shows none?', 1),
    ('☐ Redirect for partitions\n[ ] Public snapshots\n✓ Element tree for documents\n☐ Snapshot for attempts\n[x] Time window for outcomes\n☐ Frontier Garmoor\n☐ Frontier Somithal', 0),
    ('the crawl of valey stopped after 157 pages because the outbox was full', 1),
    ('__________________________________\n__________________________________________________\n======\n..................\n........\n*********************************************************', 0),
)
CALIBRATION = HOLDOUT + tuple(x for i, x in enumerate(READ) if i // 2 % 2 == 0)
KEPT_OUT = tuple(x for i, x in enumerate(READ) if i // 2 % 2 == 1)
