"""Small files of every format, encoded by hand from the formats' own descriptions: (name, hexadecimal bytes).

What they show is written down apart, as SQL, in ``known_sql``.
"""

KNOWN_FILES = (
    # one bit, 1 is white, rows padded by two bytes
    (
        "0.fbm",
        "256269746d61700033000000000000003200000000000000310000000000000031000000000000003800000000000000350000000000000000000000313000000000000000000000300000000000000000000000312e30000000"
        "0000000000007469746c6500000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000"
        "0000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000001000100000000010000",
    ),
    # 24 bits, blue first
    ("1.sun", "59a66a95000000020000000100000018000000000000000100000000000000000302010605040000"),
    # 9 x 1 bits, 0 is black
    ("2.cmu", "f10040bb00000009000000010001557f"),
    # text with a maximum of 15
    ("3.pnm", "50332032203120313520313520302037203020313520310a"),
    # hexadecimal, bottom row first
    ("4.faces", "46697273744e616d653a204164610a4c6173744e616d653a20420a506963446174613a2032203220380a496d6167653a2032203220380a0a303130320a303366660a"),
    # two of a palette
    ("5.png", "89504e470d0a1a0a0000000d4948445200000002000000010803000000c3fc8fb800000006504c544501020304050695536f480000000b49444154789c636064000000050002d16633780000000049454e44ae426082"),
    # interlaced, four colours
    ("6.gif", "47494638396104000400810000000000ff000000ff000000ff21f90400000000002c0000000004000400400207443409162df00a003b"),
    # two flat blocks of 200 and 55
    (
        "7.jpeg",
        "ffd8ffdb00430008080808080808080808080808080808080808080808080808080808080808080808080808080808080808080808080808080808080808080808080808080808ffc0000b080008001001011100ffc4001f0000"
        "00000c000000000000000000000000000102030405060708090a0bffc40014100100000000000000000000000000000000ffda0008010100003f0079086e7fffd9",
    ),
    # five scans of one block: 400 and, beside it, 80 of the first cosine
    (
        "8.progressive",
        "ffd8ffdb00430001010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101010101ffc2000b080008000801011100ffc401130000"
        "000000000000808000000000000000000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f202122232425262728292a2b2c2d2e2f303132333435363738393a3b3c3d3e3f404142434445464748494a"
        "4b4c4d4e4f505152535455565758595a5b5c5d5e5f606162636465666768696a6b6c6d6e6f707172737475767778797a7b7c7d7e7f808182838485868788898a8b8c8d8e8f909192939495969798999a9b9c9d9e9fa0a1a2a3a4"
        "a5a6a7a8a9aaabacadaeafb0b1b2b3b4b5b6b7b8b9babbbcbdbebfc0c1c2c3c4c5c6c7c8c9cacbcccdcecfd0d1d2d3d4d5d6d7d8d9dadbdcdddedfe0e1e2e3e4e5e6e7e8e9eaebecedeeeff0f1f2f3f4f5f6f7f8f9fafbfcfdfe"
        "ffffc401131000000000000000808000000000000000000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f202122232425262728292a2b2c2d2e2f303132333435363738393a3b3c3d3e3f40414243"
        "4445464748494a4b4c4d4e4f505152535455565758595a5b5c5d5e5f606162636465666768696a6b6c6d6e6f707172737475767778797a7b7c7d7e7f808182838485868788898a8b8c8d8e8f909192939495969798999a9b9c9d"
        "9e9fa0a1a2a3a4a5a6a7a8a9aaabacadaeafb0b1b2b3b4b5b6b7b8b9babbbcbdbebfc0c1c2c3c4c5c6c7c8c9cacbcccdcecfd0d1d2d3d4d5d6d7d8d9dadbdcdddedfe0e1e2e3e4e5e6e7e8e9eaebecedeeeff0f1f2f3f4f5f6f7"
        "f8f9fafbfcfdfeffffda000801010000000108c8ffda0008010100013f0205a007ffda0008010100013f21007fffda00080101000000107fffda0008010100013f10007fffd9",
    ),
    # bottom row first
    ("9.rle", "52cc00000000030002000201080000000200050201020300010102000502040506000700"),
    # 4-bit runs and literals
    (
        "10.bmp",
        "424d00000000000000007600000028000000050000000200000001000400020000000000000000000000000000000000000000000000000000000101010002020200030303000404040005050500060606000707070008080800"
        "090909000a0a0a000b0b0b000c0c0c000d0d0d000e0e0e000f0f0f00051200000003abc00001",
    ),
    # gzipped; rows of luma 100 and 182
    (
        "11.pcd",
        "1f8b08000000000002ffedd23111c0201000c1784b9aef704083193ca023f6c0011dc5337b126e76ce7d8f2449baaef27e354a182149922449922449d245b5e4fdc91b87eb87e3871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8"
        "e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8"
        "e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8e1871f7ef8c9e26701e05262f600b00000",
    ),
    # palette of 0, 1000, 2000, 3000 in red
    (
        "12.xwd",
        "000000640000000700000002000000080000000300000001000000000000000100000008000000010000000800000008000000040000000300000000000000000000000000000008000000040000000400000000000000000000"
        "000000000000000000000000000000000000000007000000000103e80000000007000000000207d0000000000700000000030bb800000000070003010200",
    ),
    # a run and a literal of gray
    ("13.tga", "00000b0000000000000000000500010008208207010809"),
    # gzipped; 2 rows of 3
    ("14.mcidas", "1f8b08000000000002ff6360000316201661c00e9880981988191946c128186e80918999e51f00290fbe5506030000"),
    # four rows of 64 white and 64 black, in turn
    ("15.g3", "001d9a81e1b8009a81e1becd400766a0786e0026a0786fb350010010010010010010"),
    # gzipped; palette k, 0, 255 - k
    (
        "16.pcx",
        "1f8b08000000000002ffa5c187420d000040d1fbd25e5a465349d3562a454b848a4a46f656544a54664a85b292069552118a4265afec9996920815421ba1886fe01c491181387f09f18f04c2fc8f423109a4a15bc06f217ef5a0"
        "4b984e117e8af2438cefe27448f04d92af527c91a65d8636595a7bd22247b33c4d0a342af259894fbdf8d89b863e7ce8cb7b65dea950af4a9d1ab5eabcd5e04d3f5e6b52a3c5abfebcd4a67a002f74a8d2e5b91e95fa5418f0cc"
        "90f281940da274302543281ecad361140de7c9081e1bf1c89887237960c27d53ee9971771477ccb96dc1add1dc1c43a12537acb86ecd351baeda72652c97edb8348e8be3b960cff9099c9b48c124f21dc873e4ac136726737a0a"
        "b9cee4b870ca959353c976236b1a27a6737c06c76692e9ced1591c994dc61cd2e792368fc3f3495d40ca420e2d227931494b485ccac1651c584e8207f19ec4ad207625fbbd88f1669f0fd1abd8ebcb1e3f76af66973f3bd710b5"
        "96c8007604b23d886deb88584ff806c236b27513a19b090966cb168243d81ccaa6ad6c0c634338eb2358b78da0ed04ee202092b551acd989ff2e56efc66f0fbe7b59158dcf3ebc63f0dacfca5856c4e1198f4702cb0fb0ec204b"
        "135992c4e264161d62610a0b52997f987969cc4d674e06b38f30eb28ee99cc3cc68ce34c3fc1b42cdcb2997a12d753b8e4e09ccb94d34c3e83d3591cf370c867520113cf31e13cf617187f917197b0bbccd82bd85ec5e61ad6d7"
        "b1ba816521636e32fa1616b731bfc3a8bb98ddc3f43e260f18f910e347183d66c413861731ec29438b1952c2e052069531b01cc3671854a05f89de7374abd079c1806ab45fd2ff155a3568bea6df1b34dea25e8b5a1daaf5a8bc"
        "43f93d7d3fd0a781de1fe9f509a5cf2836a2d0847c33722df46c45b60d9976a4bf20f515c96f487420fe1db11f88fe44a413e12e7afc42e837826ef8033450182885030000",
    ),
    # a row twice, a literal, a run
    ("17.img", "000100080001000200550055000d00040000ff028002aaf0000111228101"),
    # gzipped; 719 rows of F0 and one that counts up
    (
        "18.mac",
        "1f8b08000000000002ff636018052319ecfc300a47e1281c85a370f0417706462666165636760e4e2e6e1e5e3e7e0141216111513171094929691959397905452565155535750d4d2d6d1d5d3d7d03432363135333730b4b2b6b"
        "1b5b3b7b074727671757377700880104dde7070000",
    ),
    # three colours by name
    (
        "19.xpm",
        "2f2a2058504d202a2f0a7374617469632063686172202a785b5d203d207b0a2232203220332031222c0a2261206320726564206d207768697465222c0a226220632023303066222c0a22632063204e6f6e652067342067726179"
        "3530222c0a226162222c0a226361227d3b0a",
    ),
    # 9 x 2 bits
    ("20.xbm", "23646566696e6520785f776964746820390a23646566696e6520785f68656967687420320a737461746963206368617220785f626974735b5d203d207b0a20307830352c20307830312c20307830302c20307830307d3b0a"),
    # old compression
    ("21.pgm.Z", "1f9d8c506a80903170608d1a0a0004103000"),
    # uuencoded
    ("22.uu", "626567696e2036343420782e70676d0a2f342334402c422052282328552d304820203028230a600a656e640a"),
    # two members
    ("23.pgm.bz2", "425a6839314159265359343e14f40000031a00400012004000200030cd341234289af177245385090343e14f40425a68393141592653595d9c7fe2000002c800781012002000310c00c4c245cf55bc5dc914e142417671ff88"),
)
